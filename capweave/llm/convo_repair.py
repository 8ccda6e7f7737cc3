"""Conversation structure repair by an integer-minimum DP over scalar big-integer weights.

The dealt damage is applied in DataFrame operations: a row whose key
``conv_id:turn`` (nulls as one space) has crc32 % 20 = 0 goes, 1 empties the
text, 2 removes ``.``, ``!`` and ``?``, 3 repeats the row, 4 makes it a user
turn.  Rows of a conversation are then in order of turn (nulls first), role and
text.  A row's first fault is blank (no character but ASCII white space),
duplicate (role and text of an earlier row; by a window over equal rows) or
truncated (last such character not ``.``, ``!`` or ``?``).

The repair is the cheapest sequence of edits, one per row, whose kept roles
read ``(s?(ua)+)?`` by initials: Keep (0), Rerole to user or assistant (1),
Delete (2, the only edit of blank and duplicate rows); a kept truncated row
adds 5.  Inserting an empty turn (5) is allowed too, but never pays: an insert
followed by a kept row, or ending the conversation, is always beaten by
deleting that row (and a lone system row) at 2 each, which leaves an automaton
state that accepts at least as much.  So edits and rows correspond one to one.

Each edit is a scalar weight: cost in the high digits, the edit's letter (D, K,
R, in ASCII order) as a base-4 digit at the row's fixed position in the low
digits, padded with zeros to the end.  Over the DAG of (row, automaton state) the
ordinary integer minimum of path sums is then the cheapest repair and, among
equal costs, the ASCII-least audit: one minimum decides both, no tie rule is
needed.  The digits read back give the audit; replaying it gives the repaired
``role:text`` lines, hashed by sha256.

One conversation is one group of ``applyInPandas``: the DP is sequential over
its rows and the digest is a single sha256 over its repaired text, so a
conversation is one task (its rows in memory).  Work is O(n^2 / 64) word
operations for n rows, from the big integers.

Defined cases: null text or role is one space; a null turn sorts first and
counts for no gap; a null ``conv_id`` is a conversation of its own; a
conversation whose rows all go returns zeros, an empty audit and the sha256 of
the empty text, as does one whose repair deletes every row.  Repeated rows are
duplicates after the first.  Every ``conv_id`` of the input has one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capweave.llm.tables import ship_package

DROP, EMPTY, UNPUNCT, REPEAT, USER = 0, 1, 2, 3, 4
DAMAGE_MOD = 20
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
#: Audit letters as digits, in ASCII order; 0 pads.
DIGIT = {"D": 1, "K": 2, "R": 3}
LETTER = {v: k for k, v in DIGIT.items()}
BASE_BITS = 2
#: Automaton of ``(s?(ua)+)?``: states start, s, u, a; start and a accept.
START, SYS, USR, AST = 0, 1, 2, 3
STEP = {(START, "s"): SYS, (START, "u"): USR, (SYS, "u"): USR, (USR, "a"): AST, (AST, "u"): USR}
ACCEPT = (START, AST)
LEGAL_PAIRS = ("su", "ua", "au")
_SPACE = r"\x20\x09-\x0D"
OUT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def damage_code() -> Column:
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), F.lit(" ")),
    )
    return F.crc32(key.cast("binary")) % DAMAGE_MOD


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text, ``fault`` (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    rows = conversations.select(
        "conv_id", "turn",
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    ).withColumn("_d", damage_code())
    rows = rows.filter(F.col("_d") != DROP).select(
        "conv_id", "turn",
        F.when(F.col("_d") == USER, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_d") == EMPTY, F.lit(""))
        .when(F.col("_d") == UNPUNCT, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == REPEAT, 2).otherwise(1))).alias("_copy"),
    )
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "_copy")
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    truncated = ~F.col("text").rlike(f"[.!?][{_SPACE}]*$")
    fault = F.when(blank, 1).when(F.row_number().over(same) > 1, 2).when(truncated, 3).otherwise(0)
    return rows.withColumn("fault", fault).drop("_copy")


def repair(roles: list[str], texts: list[str], faults: list[int]) -> tuple[int, str, str]:
    """(cost, audit, sha256 of the repaired text) of one conversation's rows in order."""
    n = len(roles)
    shift = BASE_BITS * n
    best: dict[int, int] = {START: 0}
    for i, (role, fault) in enumerate(zip(roles, faults)):
        place = BASE_BITS * (n - 1 - i)
        nxt: dict[int, int] = {}

        def offer(state: int, weight: int) -> None:
            if state not in nxt or weight < nxt[state]:
                nxt[state] = weight

        extra = TRUNCATED_COST if fault == 3 else 0
        for state, weight in best.items():
            offer(state, weight + (DELETE_COST << shift) + (DIGIT["D"] << place))
            if fault in (1, 2):
                continue
            kept = STEP.get((state, role[:1]))
            if kept is not None:
                offer(kept, weight + ((KEEP_COST + extra) << shift) + (DIGIT["K"] << place))
            for target in ("u", "a"):
                moved = STEP.get((state, target))
                if moved is not None:
                    offer(moved, weight + ((REROLE_COST + extra) << shift) + (DIGIT["R"] << place))
        best = nxt
    weight = min(best[s] for s in ACCEPT if s in best)
    cost, digits = weight >> shift, weight & ((1 << shift) - 1)
    audit = "".join(LETTER[(digits >> (BASE_BITS * (n - 1 - i))) & 3] for i in range(n))
    lines, state = [], START
    for letter, role, text in zip(audit, roles, texts):
        if letter == "D":
            continue
        if letter == "R":
            role = "user" if (state, "u") in STEP else "assistant"
        state = STEP[(state, role[:1])]
        lines.append(f"{role}:{text}")
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _conversation(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("_o", kind="stable")
    roles, texts, faults = frame["role"].tolist(), frame["text"].tolist(), frame["fault"].tolist()
    cost, audit, digest = repair(roles, texts, faults)
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))
    counts = [sum(f == k for f in faults) for k in (1, 2, 3)]
    conv = frame["conv_id"].iloc[0]
    return pd.DataFrame(
        [[None if pd.isna(conv) else int(conv), 0, *counts, illegal, cost, audit, digest]],
        columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    )


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` (conv_id, turn, role, text) with the contract's columns."""
    ship_package(conversations.sparkSession)
    rows = damaged(conversations)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("_o", F.row_number().over(order))
    fixed = rows.select("conv_id", "role", "text", "fault", "_o").groupBy("conv_id").applyInPandas(_conversation, OUT)
    turns = rows.filter(F.col("turn").isNotNull()).groupBy("conv_id", "turn").count().groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("_gaps")
    )
    every = conversations.select("conv_id").distinct()
    fixed = fixed.drop("gaps").withColumnRenamed("conv_id", "_fc")
    turns = turns.withColumnRenamed("conv_id", "_tc")
    out = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("_fc")), "left")
    out = out.join(turns, F.col("conv_id").eqNullSafe(F.col("_tc")), "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "conv_id",
        F.coalesce("_gaps", zero).alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
