"""Chat formatting of reply trees.

Messages form trees by parent; iterated self-joins of pointers that double
their reach give each message its root, depth and path score in a number of
rounds that grows with the logarithm of the depth.  Leaves are the branches;
they are ranked by score, and each chosen branch, root to leaf, is formatted
as one conversation with the spans of its assistant texts as loss mask.

Template: each turn is ``<turn>role\\ntext</turn>\\n``.  Inside texts the control
strings ``<turn>`` and ``</turn>``, with any number of backslashes after the
``<``, get one backslash more, so a text can't end or open a turn, and taking
one off gives the text back.  Roles are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.graph import cut

OPEN, CLOSE = "<turn>", "</turn>\n"
_ESCAPED = re.compile(r"<\\(\\*)(/?turn>)")


def escape_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)(/?turn>)", r"<\\$1$2")


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1] + m[2], text)


def conversation_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Flat turns as messages (``tree``, ``msg``, ``parent``, ``role``, ``text``, ``score``).

    Each turn replies to the one before it, so a flat conversation is a tree
    with one branch.  Turns with the same number are ordered by role and text;
    a null turn comes first, as in any ascending order.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    place = rows.withColumn("msg", F.row_number().over(order).cast("bigint"))
    return place.select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(messages: DataFrame, best: int = 1, max_rounds: int = 40) -> DataFrame:
    """The messages of the ``best`` branches of each tree.

    ``messages``: ``tree``, ``msg`` long (unique in a tree), ``parent`` (null, or
    absent from the tree: a root), ``score`` double (null: 0).  Returns ``tree``,
    ``rank`` (1 is the best), ``depth`` (0 is the root), ``msg``.  A branch's
    score is the sum over its messages; of equal ones the smaller leaf is
    first.  Cycles are refused.
    """
    nodes = cut(messages.select(F.col("tree"), F.col("msg").cast("bigint").alias("msg"), F.col("parent").cast("bigint").alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score")))
    there = nodes.select(F.col("tree").alias("tree2"), F.col("msg").alias("msg2"))
    nodes = nodes.join(there, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("parent") == F.col("msg2")), "left").select("tree", "msg", F.col("msg2").alias("parent"), "score")
    # up: the ancestor 2^k above (null past the root), steps: distance to what is reached, total: scores on the way
    reach = cut(nodes.select("tree", "msg", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("bigint").alias("steps"), F.col("score").alias("total")))
    jumps = [reach.select("tree", "msg", "up")]
    for _ in range(max_rounds):
        if reach.where("up is not null").isEmpty():
            break
        # messages that have reached past their root are done and move no more
        going = reach.where("up is not null")
        above = reach.select(F.col("tree").alias("tree2"), F.col("msg").alias("msg2"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        joined = going.join(above, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("up") == F.col("msg2")))
        further = joined.select("tree", "msg", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total"))
        reach = cut(further.unionByName(reach.where("up is null")))
        jumps.append(reach.select("tree", "msg", "up").where("up is not null"))
    else:
        raise ValueError("the replies hold a cycle")
    parents = nodes.where("parent is not null").select(F.col("tree").alias("tree2"), F.col("parent").alias("msg2")).distinct()
    leaves = reach.join(parents, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("msg") == F.col("msg2")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("msg"))
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    # from each chosen leaf, all ancestors: the sums of powers of two
    marked = chosen.select("tree", "rank", "msg", F.col("steps").alias("depth"))
    for k, jump in enumerate(jumps):
        step = jump.where("up is not null").select(F.col("tree").alias("tree2"), F.col("msg").alias("msg2"), "up")
        above = marked.join(step, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("msg") == F.col("msg2")))
        marked = cut(marked.unionByName(above.select("tree", "rank", F.col("up").alias("msg"), (F.col("depth") - 2**k).alias("depth"))))
    return marked


def format_branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """``tree``, ``rank``, ``formatted`` and ``loss`` (array of start, length in code points).

    One row holds one conversation, the unit of the output.  Null roles and
    texts are empty; an empty table gives no rows.
    """
    on = branches(messages, best)
    said = messages.select(F.col("tree").alias("tree2"), F.col("msg").alias("msg2"), "role", "text")
    turns = on.join(said, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("msg") == F.col("msg2")))
    head = F.concat(F.lit(OPEN), F.url_encode(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape_text(F.col("text"))
    turn = F.struct("depth", (F.coalesce("role", F.lit("")) == "assistant").alias("learn"), head.alias("head"), body.alias("body"))
    rows = turns.groupBy("tree", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = rows.withColumn("formatted", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), ""))
    sizes = rows.withColumn("sizes", F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["learn"].alias("learn"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        span = F.struct((state["at"] + t["head"]).alias("start"), t["body"].alias("length"))
        spans = F.when(t["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + t["head"] + t["body"] + len(CLOSE)).alias("at"), spans.alias("spans"))

    return sizes.select("tree", "rank", "formatted", F.aggregate("sizes", start, add, lambda s: s["spans"]).alias("loss"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for block in formatted.split(CLOSE)[:-1]:
        role, _, text = block.removeprefix(OPEN).partition("\n")
        turns.append((unquote_plus(role), unescape_text(text)))
    return turns


def digest_formatted(rows: DataFrame) -> DataFrame:
    """``tree``, ``rank`` and the digests of what the formatted conversations say when read back."""

    @F.arrow_udf("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    def digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        made: list[list] = [[], [], [], [], []]
        for text, loss in zip(texts.to_pylist(), spans.to_pylist()):
            turns = read_back(text)
            learned = "".join(unescape_text(text[s["start"] : s["start"] + s["length"]]) for s in loss)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            for column, value in zip(made, (len(turns), _sha(said), len(learned), _sha(learned), len(text))):
                column.append(value)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rows.select("tree", "rank", digest("formatted", "loss").alias("d")).select("tree", "rank", "d.*")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
