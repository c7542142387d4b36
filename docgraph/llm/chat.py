"""Chat formatting of reply trees, with DataFrame functions only.

A reply tree is a table of messages with parents. `paths` enumerates all root-to-leaf paths by
iterative self-joins that double the distance each round: (leaf, ancestor, distance) rows meet the
pointers that jump as far, so a path of length n takes about log2(n) rounds and no row ever holds more than one
message. Branches of a tree are ranked by the sum of their scores; `conversations` formats the
chosen ones.

Template: each turn is `<|turn|>` role newline text `<|end|>` newline. Inside roles and texts, `\\\\` escapes itself and
is put into everything that looks like a control string of this or another common template (`<|`, `<s>`, `</s>`,
`[INST]`, `[/INST]`). In a role, a newline becomes a backslash and `n`, so the first raw newline of a turn ends its role.
Unescaping drops one backslash before each character (in roles, `\\n` is a newline), so any text comes back exactly. No pattern
repeats a group, so roles and texts may have any length. The loss mask lists [start, end) code points of assistant texts in the formatted string.

Nulls: a null text or role is empty; a null score counts 0; a message whose parent is null or missing is a root. A message that is its own ancestor
is on no path from a root, and so is a message without an id. Repeated node ids are an error of the input: rows of one id are reduced to the one with the smallest role and text.
In chains (`from_turns`), rows of one turn are ordered by role and text, and repeated rows are turns of their own; null turns come first.
Rows with a null conversation form one conversation. Empty tables give empty results. Columns beyond those named are kept by
`formatted` (but for formatted and loss_mask, which it sets) and not read elsewhere. One conversation is one row, so its texts together must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

TURN, END = "<|turn|>", "<|end|>"
CONTROL = r"(<)(?=\||/?s>)|(\[)(?=/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), CONTROL, r"$1$2\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    # between doubled backslashes, a backslash stands for itself only where n follows
    parts = F.transform(F.split(c, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit("")))
    return F.array_join(parts, "\\")


def from_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as a reply tree in which each row answers the one before it: tree, node (number in the conversation), parent, role, text, score."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # sorting whole rows: only conversations are windows, and their size is that of the formatted result
    numbered = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.row_number().over(order).cast("long"))
    node = F.struct("conv_id", "n")
    return numbered.select(
        F.col("conv_id").alias("tree"), node.alias("node"), F.when(F.col("n") > 1, F.struct(F.col("conv_id"), (F.col("n") - 1).alias("n"))).alias("parent"), "role", "text", F.lit(0.0).alias("score"),
    )


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, up (steps from the leaf) of all root-to-leaf paths. messages: tree, node, parent."""
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"))
    linked = checkpointed(linked.dropDuplicates(["tree", "node"]))
    parents = linked.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = linked.join(parents, ["tree", "node"], "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jump = linked.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("to"))
    step, longest = 1, None
    while True:
        jump = checkpointed(jump)
        more = checkpointed(found.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up")))
        if more.isEmpty():
            return found
        if step >= 64 and longest is None:
            longest = linked.groupBy("tree").count().agg(F.max("count")).first()[0]
        if longest is not None and step > longest:  # what still goes on goes round in circles
            roots = linked.where("parent IS NULL").select("tree", "node")
            return found.join(found.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct(), ["tree", "leaf"], "left_semi")
        found = found.unionAll(more)
        far = jump.select("tree", F.col("node").alias("low"), F.col("to").alias("node"))
        jump = far.join(jump, ["tree", "node"]).select("tree", F.col("low").alias("node"), "to")
        step *= 2


def ranked_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """tree, leaf, branch (rank by falling score, then leaf), turns (array of role, text from root to leaf)."""
    # a struct equals another with the same null inside, so a null tree is a tree
    one = messages.where("node IS NOT NULL").withColumn("tree", F.struct(F.col("tree").alias("of"))).groupBy("tree", "node").agg(F.min(F.struct("role", "text", "score", "parent")).alias("m")).select("tree", "node", "m.*")
    on_path = paths(one).join(one.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    turns = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    made = on_path.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), turns.alias("turns"))
    ranked = made.select("tree", "leaf", "score").withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("branch") <= best)
    return made.join(ranked.drop("score"), ["tree", "leaf"]).select(F.col("tree")["of"].alias("tree"), "leaf", "branch", "turns")


def formatted(conversations: DataFrame) -> DataFrame:
    """Adds formatted (string) and loss_mask (array of start, end) to a table with turns."""
    piece = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"), F.lit(END + "\n").alias("tail"), (t["role"] == "assistant").alias("learn"),
        ),
    )
    pieces = "pieces"
    while pieces in conversations.columns:
        pieces += "_"
    made = conversations.withColumn(pieces, piece)
    # running code point positions, one number per turn
    start = F.aggregate(
        pieces, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).alias("at"),
            F.when(p["learn"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))).otherwise(acc["mask"]).alias("mask"),
        ),
    )
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return made.withColumns({"formatted": text, "loss_mask": start["mask"]}).drop(pieces)


def read_back(c: Column) -> Column:
    """Turns (role, text) of a formatted string."""
    # a turn's text ends at the first control string: inside texts these are escaped
    turns = F.slice(F.split(c, r"<\|turn\|>"), 2, 1 << 30)
    def one(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        body = F.substr(t, F.length(role) + F.lit(2), F.length(t) - F.length(role) - F.lit(2 + len(END)))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, one)


def digests(made: DataFrame) -> DataFrame:
    """What the formatted strings and masks hold, read back from them."""
    learned = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    back = made.withColumns({"back": read_back(F.col("formatted")), "learned": learned})
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("back").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<\|', '<\\|', 'g'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), 'x^', '') AS body FROM every
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(role) + length(body) + 17)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
