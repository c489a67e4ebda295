"""Chat formatting of reply trees.

Every message names the one it replies to. Self-joins that double the distance each round give every message its root, its depth and the sum of
scores above it; the leaves of a tree are ranked by the mean score of their branch. The messages of the chosen branches are found by the same joins,
walked down from long jumps to short ones, so a thread of n messages takes about 2 log2(n) joins. Only ids are joined; texts meet their branch once.

The template is ``<s>``, then a turn after the other: ``[INST] text [/INST]`` for a user, `` text </s>`` for an assistant, and
``<<SYS>>role\\ntext<</SYS>>`` for any other role. Where a text holds such a mark, a backslash is put behind the first character of it (one more, if some
are there), which ``unescape`` takes back. The loss mask lists the code points of assistant texts.

Defined results: a message whose parent is null or not in the table is a root; of messages that reply to each other in a ring the one with the least id is the root;
a message without an id is a conversation of its own; of rows with equal ids the least one (parent, score, role, text) stays; a null score or NaN is 0;
equal mean scores are ranked by the id of the leaf; null texts and roles are empty; an empty table gives an empty result. A conversation is one value and must fit one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.config import pin

BEGIN, USER, ASSISTANT, OTHER = "<s>", ("[INST] ", " [/INST]"), (" ", " </s>"), ("<<SYS>>", "<</SYS>>")
#: A control string: its first character, backslashes, the rest.
CONTROL = r"([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>)"
_ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>|</?SYS>>)")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|<<SYS>>(?P<role>.*?)\n(?P<other>.*?)<</SYS>>", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    at = len(BEGIN)
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        kind = "role" if turn["role"] is not None else turn.lastgroup
        if kind == "role":
            yield re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(turn["role"])), unescape(turn["other"])
        else:
            yield kind, unescape(turn[kind])
        at = turn.end()


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``nodes`` (node, up, score) with a null ``up`` at roots, without rings but those it reports: every node with ``up`` null, or still in a
    ring, its top, hops, total and the least node passed; and for each k the jumps (node, up) over 2^k replies."""
    first = nodes.select(
        "node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("top"), F.lit(0).cast("long").alias("hops"), F.col("score").alias("total"),
        F.when(F.col("up").isNotNull(), F.col("node")).alias("least"),
    )
    now = pin(first)
    ended, alive = now.where(F.col("up").isNull()), now.where(F.col("up").isNotNull())
    count, jumps = now.count(), []
    while (1 << len(jumps)) <= 2 * count and not alive.isEmpty():
        step = F.lit(1 << len(jumps)).cast("long")
        jumps.append(alive.select("node", "up"))
        # Only messages that have not reached their root are joined; what they reach may have.
        above = ended.unionByName(alive).select(F.col("node").alias("k"), *[F.col(c).alias(f"{c}_") for c in ("up", "top", "hops", "total", "least")])
        # A message with very many replies is a hot key of this join; it is followed by no grouping, so adaptive execution may split it.
        now = pin(
            alive.join(above, F.col("up") == F.col("k")).select(
                "node", F.col("up_").alias("up"), F.col("top_").alias("top"), (F.col("hops_") + step).alias("hops"), (F.col("total") + F.col("total_")).alias("total"),
                F.least("least", "least_").alias("least"),
            )
        )
        ended, alive = ended.unionByName(now.where(F.col("up").isNull())), now.where(F.col("up").isNotNull())
    # One table again: what is joined to it next would otherwise be joined to each part of the union.
    return pin(ended.unionByName(alive)), jumps


def branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(leaf, node, place, branch_score, branch_rank): the messages of the ``best`` branches of each tree (all for None), roots at place 0.
    ``messages``: node (distinct, not null), parent, score."""
    there = messages.select(F.col("node").alias("k"))
    linked = pin(messages.join(there, F.col("parent") == F.col("k"), "left").select("node", F.col("k").alias("up"), "score"))
    done, jumps = _climb(linked)
    rings = done.where(F.col("up").isNotNull())
    if not rings.isEmpty():
        # After as many replies as there are messages, each jump ends in a ring; the least node of a ring is cut loose.
        on_ring = rings.select(F.col("up").alias("node")).distinct().join(rings.select("node", "least"), "node").where("node = least").select(F.col("node").alias("cut"))
        linked = pin(linked.join(on_ring, F.col("node") == F.col("cut"), "left").select("node", F.when(F.col("cut").isNull(), F.col("up")).alias("up"), "score"))
        done, jumps = _climb(linked)
    parents = linked.select(F.col("up").alias("p")).where(F.col("p").isNotNull())
    leaves = done.join(parents, F.col("node") == F.col("p"), "left_anti").withColumn("branch_score", F.col("total") / (F.col("hops") + 1))
    # The limit on the rank is applied in every task before the shuffle, so a tree of very many leaves is not sorted by one.
    order = Window.partitionBy("top").orderBy(F.desc("branch_score"), "node")
    ranked = leaves.withColumn("branch_rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.where(F.col("branch_rank") <= best)
    path = pin(ranked.select(F.col("node").alias("leaf"), "node", F.col("hops").alias("place"), "branch_score", "branch_rank"))
    for k, jump in reversed(list(enumerate(jumps))):
        up = path.join(jump.select(F.col("node").alias("k"), "up"), F.col("node") == F.col("k"))
        path = pin(path.unionByName(up.select("leaf", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"), "branch_score", "branch_rank")))
    return path


def conversations(
    messages: DataFrame, id_col: str, parent_col: str, role_col: str = "role", text_col: str = "text", score_col: str | None = None, keep: list[str] | None = None, best: int | None = 1
) -> DataFrame:
    """A row per chosen branch: leaf_id, columns ``keep`` of the leaf, branch_score, branch_rank, n_turns, formatted, loss (array of begin, end)."""
    keep = keep or []
    score = F.nanvl(F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if score_col else F.lit(0.0)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = messages.select(
        F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string"))).alias("node"),
        F.concat(F.lit("i"), F.col(parent_col).cast("string")).alias("parent"), score.alias("score"), empty(role_col).alias("role"), empty(text_col).alias("text"),
        F.col(id_col).alias("leaf_id"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("kept"),
    )
    rows = pin(named.groupBy("node").agg(F.min(F.struct("parent", "score", "role", "text", "leaf_id", "kept")).alias("m")).select("node", "m.*"))
    chosen = branches(rows.select("node", "parent", "score"), best)
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    role = escaped(F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))
    head = F.when(user, F.lit(USER[0])).when(assistant, F.lit(ASSISTANT[0])).otherwise(F.concat(F.lit(OTHER[0]), role, F.lit("\n")))
    tail = F.when(user, F.lit(USER[1])).when(assistant, F.lit(ASSISTANT[1])).otherwise(F.lit(OTHER[1]))
    turns = rows.withColumnRenamed("node", "k").join(chosen, F.col("k") == F.col("node")).select(
        "leaf", "place", "branch_score", "branch_rank", F.when(F.col("leaf") == F.col("node"), F.struct("leaf_id", "kept")).alias("end"), head.alias("head"),
        escaped(F.col("text")).alias("body"), tail.alias("tail"), assistant.alias("learn"),
    )
    before = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.length("tail")
    begin = F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + len(BEGIN) + F.length("head")
    placed = turns.withColumn("begin", begin).select(
        "leaf", "place", "branch_score", "branch_rank", "end", F.concat("head", "body", "tail").alias("piece"),
        F.when(F.col("learn"), F.struct(F.col("begin"), (F.col("begin") + F.length("body")).alias("end"))).alias("span"),
    )
    whole = placed.groupBy("leaf").agg(
        F.first("end", ignorenulls=True).alias("end"), F.first("branch_score").alias("branch_score"), F.first("branch_rank").alias("branch_rank"),
        F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"), F.sort_array(F.collect_list("span")).alias("loss"),
    )
    formatted = F.concat(F.lit(BEGIN), F.array_join("pieces.piece", ""))
    return whole.select("end.leaf_id", *[F.col(f"end.kept.{c}").alias(c) for c in keep], "branch_score", "branch_rank", "n_turns", formatted.alias("formatted"), "loss")


def threaded(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A plain table of turns as messages (message, reply_to, conv, role, text): each turn replies to the one before it in its conversation.

    Rows are ordered by turn (null first), role and text, over range-sorted parts, so a conversation may be spread over many. Rows with a null conversation are one.
    """
    from lociframe.plans.ranged import neighbours, range_sorted, row_index

    slim = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("copy"),
    )
    s = row_index(range_sorted(slim, "conv", "turn", "role", "text", "copy"), "message")
    follows = F.col("prev").isNotNull() & F.col("prev.conv").eqNullSafe(F.col("conv"))
    return neighbours(s, ["conv"]).select("message", F.when(follows, F.col("message") - 1).alias("reply_to"), "conv", "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``formatted`` and its loss mask, added to its other columns: turns_sha256, read_turns, loss_chars, loss_sha256, formatted_chars."""
    import hashlib

    schema = "read_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    @F.pandas_udf(schema)
    def read(text: pd.Series, loss: pd.Series) -> pd.DataFrame:
        out = []
        for whole, spans in zip(text, loss, strict=True):
            turns, learned, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, said in parse(whole):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for span in spans:
                part = unescape(whole[span["begin"] : span["end"]])
                learned.update(part.encode())
                chars += len(part)
            out.append((n, turns.hexdigest(), chars, learned.hexdigest(), len(whole)))
        return pd.DataFrame(out, columns=["read_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    others = [c for c in formatted.columns if c not in ("formatted", "loss")]
    return formatted.withColumn("read", read("formatted", "loss")).select(*others, "read.*")
