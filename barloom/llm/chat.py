"""Chat formatting: reply trees to one formatted conversation per chosen path.

Messages name the message that they answer. Self-joins on the answered message, each doubling the steps of the last,
give every message its depth and the sum of the scores above it; leaves are ranked by the mean score of their path and
the best ``branches`` of a tree are kept. The same jumps, from the longest to the shortest, then enumerate the messages
of the chosen paths only. A tree of depth d takes about 2 log2(d) joins, whatever its branches.

A path becomes one text of turns::

    ### role:
    text
    </turn>

Every ``###`` and ``</turn>`` inside a text gets one backslash more than it has, so no text can look like a mark and the
way back takes one away. In a role, backslashes and line ends are escaped. ``loss`` holds the code-point spans of the
texts to learn from.

Defined results: null roles and texts are empty; a null tree is a tree of its own; a message without id can't be
answered; a message whose parent is null or not in its tree is a root; of rows with one id in a tree the smallest
(parent, role, text, score) counts; a null score is 0; messages on or below a cycle are on no path from a root and give no
conversation. Equal scores go to the smaller leaf id as text. Columns that are not named are not read, and an empty table
gives an empty result. A conversation is one row, as it is one output record; nothing else gathers a tree in a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ordered import with_ordinal
from barloom.llm.stage import again, stage

CONTROL = "###|</turn>"
END = "\n</turn>\n"
LOSS_ROLES = ("assistant",)
_FREE = re.compile(rf"(?<!\\)(\\*+)({CONTROL})")
_HELD = re.compile(rf"(?<!\\)\\(\\*+)({CONTROL})")


def escape(text: str) -> str:
    return _FREE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _HELD.sub(r"\1\2", text)


def _role_out(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def write(turns: Iterable[tuple[str, str]], loss_roles: Sequence[str] = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the spans under the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {_role_out(role)}:\n", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        body = formatted.index("\n", at) + 1
        end = formatted.index(END, body)
        turns.append((_role_in(formatted[at + 4 : body - 2]), unescape(formatted[body:end])))
        at = end + len(END)
    return turns


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def chain(conversations: DataFrame) -> DataFrame:
    """(conv_id, id, parent, role, text, score) of rows by turn (null first, ties by role and text), each the reply to the one before."""
    rows = conversations.select(
        "conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), _key(F.col("conv_id")).alias("tree"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.col("turn").isNotNull().alias("given"),
    )
    numbered = with_ordinal(rows, ["tree"], ["turn", "given", "role", "text"], "id")
    return numbered.select("conv_id", "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _messages(messages: DataFrame, tree: str) -> DataFrame:
    """(tree, of, node, up, role, text, score): one row per message; ``up`` is null for roots."""
    fields = F.struct(
        F.when(F.col("parent").isNotNull(), _key(F.col("parent"))).alias("up"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    nameless = F.concat(F.lit("?"), F.sha2(F.to_json(fields), 256))
    rows = messages.select(_key(F.col(tree)).alias("tree"), F.col(tree).alias("of"), F.when(F.col("id").isNull(), nameless).otherwise(_key(F.col("id"))).alias("node"), fields.alias("m"))
    one = stage(rows.groupBy("tree", "node").agg(F.first("of").alias("of"), F.min("m").alias("m")).select("tree", "of", "node", "m.*"))
    known = again(one).select("tree", F.col("node").alias("up"), F.lit(True).alias("known"))
    return stage(one.join(known, ["tree", "up"], "left").withColumn("up", F.when(F.col("known"), F.col("up"))).drop("known"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The ancestors 1, 2, 4, ... steps up (tree, node, up), and (tree, node, depth, total) of all that reach a root.

    Only messages that have not reached their root take part in a round, so a few deep trees cost the others nothing.
    """
    largest = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    level = stage(messages.select("tree", "node", "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    jumps, settled = [], [level.filter("up IS NULL")]
    # More steps than a tree has messages are left on a cycle only.
    while 1 << len(jumps) < 2 * largest and not level.filter("up IS NOT NULL").isEmpty():
        jumps.append(level.filter("up IS NOT NULL").select("tree", "node", "up"))
        known = _union([again(level).filter("up IS NOT NULL"), *settled])
        above = known.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("add"))
        joined = level.filter("up IS NOT NULL").join(above, ["tree", "up"])
        level = stage(joined.select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("add")).alias("total")))
        settled.append(level.filter("up IS NULL"))
    return jumps, _union(settled).select("tree", "node", "depth", "total")


def paths(messages: DataFrame, tree: str = "tree", branches: int | None = 1) -> tuple[DataFrame, DataFrame]:
    """Chosen paths as (tree, leaf, branch, branch_score, depth, node, back), ``back`` steps above the leaf, and the messages."""
    kept = _messages(messages, tree)
    jumps, reached = _jumps(kept)
    answered = again(kept).filter("up IS NOT NULL").select("tree", F.col("up").alias("node"))
    leaves = reached.join(answered, ["tree", "node"], "left_anti").withColumn("branch_score", F.col("total") / F.col("depth"))
    best = Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), "node")
    ranked = leaves.withColumn("branch", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.filter(F.col("branch") <= branches)
    chosen = stage(ranked.select("tree", F.col("node").alias("leaf"), "branch", "branch_score", "depth", "node", F.lit(0).cast("long").alias("back")))
    rows = None
    for k in reversed(range(len(jumps))):
        # A path comes in at its longest jump; from there on every jump halves the gaps between its rows.
        entering = again(chosen).filter((F.col("depth") > 1 << k) & (F.col("depth") <= 2 << k))
        rows = (entering if rows is None else rows.unionByName(entering)).join(jumps[k], ["tree", "node"], "left")
        steps = F.array(F.struct("node", "back"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))))
        rows = rows.select("tree", "leaf", "branch", "branch_score", "depth", F.explode(F.array_compact(steps)).alias("s")).select("tree", "leaf", "branch", "branch_score", "depth", "s.*")
    single = again(chosen).filter("depth = 1")
    return (single if rows is None else rows.unionByName(single)), again(kept)


def conversations(messages: DataFrame, tree: str = "tree", branches: int | None = 1, loss_roles: Sequence[str] = LOSS_ROLES) -> DataFrame:
    """(<tree>, branch, branch_score, n_turns, formatted, loss), one row per chosen path; branch 1 is a tree's best.

    ``messages`` has the columns <tree>, id, parent, role, text, score.
    """
    rows, texts = paths(messages, tree, branches)
    turns = rows.join(texts.select("tree", "of", "node", "role", "text"), ["tree", "node"])
    turn = F.struct((-F.col("back")).alias("at"), "role", "text")
    whole = turns.groupBy("tree", "leaf").agg(F.first("of").alias("of"), F.first("branch").alias("branch"), F.first("branch_score").alias("branch_score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    # The tree travels beside the text as JSON: a null among longs would turn them into doubles.
    sent = whole.select(F.to_json(F.struct(F.col("of").alias(tree), "branch", "branch_score")).alias("row"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [write(zip(r, t), loss_roles) for r, t in zip(pdf["roles"], pdf["texts"])]
            yield pd.DataFrame({"row": pdf["row"], "n_turns": [len(r) for r in pdf["roles"]], "formatted": [m[0] for m in made], "loss": [[{"start": a, "end": b} for a, b in m[1]] for m in made]})

    out = sent.mapInPandas(run, "row string, n_turns long, formatted string, loss array<struct<start: long, end: long>>")
    kind = dict(messages.dtypes)[tree]
    return out.select(F.from_json("row", f"`{tree}` {kind}, branch int, branch_score double").alias("r"), "n_turns", "formatted", "loss").select("r.*", "n_turns", "formatted", "loss")


def read_back(formatted: DataFrame, tree: str = "conv_id") -> DataFrame:
    """Digests of what the formatted texts hold: turns, and the text under the loss, both unescaped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, text, loss in zip(pdf["row"], pdf["formatted"], pdf["loss"]):
                turns = read(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                out.append((row, len(turns), whole.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["row", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    sent = formatted.select(F.col(tree).cast("string").alias("row"), "formatted", "loss")
    out = sent.mapInPandas(run, "row string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("row", F.col("row").cast(dict(formatted.dtypes)[tree])).withColumnRenamed("row", tree)
