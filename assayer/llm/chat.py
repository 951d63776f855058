"""Chat formatting of reply trees, in DataFrame functions only.

A message has a parent in its tree, or none. Self-joins that double their reach give every message its 2**k-th ancestor and the sum of the scores up to
there, one row a message and round, in as many rounds as the depth has binary digits. Leaves are ranked by the sum to their root; only chosen ones then
collect their path from the same jumps, each ancestor once, and each path is formatted as a conversation.

Template: `### Role: text</turn>\\n` for each turn. In texts and roles the escape is reversible: `\\` is `\\\\`, `###` is `\\h`,
`</turn>` is `\\t` (in roles also `:` is `\\c`), so neither control string occurs outside the template. Roles other than
system, user, assistant and tool are written as `=name`. The loss mask is a list of spans over the formatted text, one for each
assistant text.

Defined results: a null text or role is as an empty one. A parent that does not exist makes its child a root; messages on a cycle
have no path, nor have leaves below one. Rows without a tree are one more tree. Repeated rows of one message (tree, node) each appear where
it does. Empty tables give no paths. Only the named columns are read. A conversation is held whole by one task, with its texts. Of equal path scores the path with the least leaf comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, running, table

END = "</turn>\n"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    def part(p):
        for plain, coded in (("###", "\\h"), ("</turn>", "\\t"), (":", "\\c")):
            p = F.replace(p, F.lit(coded), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def header(role: Column) -> Column:
    other = F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    name = other
    for plain, shown in ROLES.items():
        name = F.when(role == plain, F.lit(shown)).otherwise(name)
    return F.concat(F.lit("### "), name, F.lit(": "))


def role_of(shown: Column) -> Column:
    name = unescape(F.substring(shown, 2, 1 << 30))
    for plain, title in ROLES.items():
        name = F.when(shown == title, F.lit(plain)).otherwise(name)
    return name


def paths(messages: DataFrame, *, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, node, up) for each message on a chosen root-to-leaf path; up counts replies below it.

    messages: tree, node, parent, score. best: paths a tree, or None for all.
    """
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("s"))
    nodes = links.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    every = cut(links.join(nodes, same("tree", "t") & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("above"), "s"))
    most = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    # Jumps of 1, 2, 4 ... replies: each message's ancestor so far up, the scores from the message up to below that one. One row a message.
    # A message whose way ends at a root keeps its whole sum; those on and below cycles never end.
    # Of repeated rows, and of several ways to one ancestor, the best counts.
    once = lambda rows: cut(rows.groupBy("tree", "node", "above").agg(F.max("s").alias("s")))
    now = once(every)
    jumps, reach = [], 1
    while reach < most and not now.filter("above IS NOT NULL").isEmpty():
        jumps.append(now.filter("above IS NOT NULL").select(F.col("tree").alias("t"), F.col("node").alias("n"), "above"))
        further = now.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("next"), F.col("s").alias("more"))
        # Only messages that have not reached their root are joined: fewer each round.
        stepped = now.filter("above IS NOT NULL").join(further, same("tree", "t") & (F.col("above") == F.col("n")))
        stepped = stepped.select("tree", "node", F.col("next").alias("above"), (F.col("s") + F.col("more")).alias("s"))
        now = once(now.filter("above IS NULL").unionByName(stepped))
        reach *= 2
    parents = every.filter("above IS NOT NULL").select(F.col("tree").alias("t"), F.col("above").alias("n")).distinct()
    leaves = now.filter("above IS NULL").join(parents, same("tree", "t") & (F.col("node") == F.col("n")), "left_anti")
    total = leaves.groupBy("tree", F.col("node").alias("leaf")).agg(F.max("s").alias("score"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    ranked = ranked.filter(F.col("rank") <= best) if best else ranked
    # Only chosen leaves collect their ancestors: each jump, the longest last, doubles what a leaf has.
    on = cut(ranked.select("tree", "leaf", "rank", "score", F.col("leaf").alias("node"), F.lit(0).alias("up")))
    for k, jump in enumerate(jumps):
        further = on.join(jump, same("tree", "t") & (F.col("node") == F.col("n")))
        further = further.select("tree", "leaf", "rank", "score", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        on = cut(on.unionByName(further))  # else the plan would double each round
    return on


def conversations(messages: DataFrame, *, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss) for each chosen path; loss is an array of (start, end) over formatted.

    messages: tree, node, parent, role, text, score.
    """
    texts = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    found = paths(messages, best=best).join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turn = F.struct((-F.col("up")).alias("place"), "role", header(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    turns = found.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    ends = running(F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)))

    def spans(es):
        end = lambda i: F.get(es, i) - len(END)
        said = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", F.struct((end(i) - F.length(t["body"])).alias("start"), end(i).alias("end"))))
        return F.filter(said, lambda x: x.isNotNull())

    loss = let(ends, spans)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return turns.select("tree", "leaf", "rank", "score", text.alias("formatted"), loss.alias("loss"))


def parsed(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""

    def turn(piece):
        shown = F.regexp_extract(piece, r"^### ([^:]*): ", 1)
        return F.struct(role_of(shown).alias("role"), unescape(F.substring(piece, F.length(shown) + 7, F.length(piece))).alias("text"))

    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages of conversations that are lists of turns (conv_id, turn, role, text): each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return numbered.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    found = conversations(from_turns(turns.unionByName(more)))
    read = found.select("tree", "formatted", parsed(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("loss_text"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')"
OP2_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), said AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role) ELSE length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + 1 END
      + length({_ESCAPED}) + 14 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(length(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text)), 0) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""
