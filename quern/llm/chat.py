"""Chat formatting of reply trees.

Messages name their parent.  Iterative self-joins on it enumerate every path from
a root to a message without a reply; each doubles the reach of the last, so a
thread of n messages takes 2 log2(n) of them.  Branches of a tree are ranked by
their messages' mean score, and the best are each formatted as one conversation.
Paths carry ids and scores only; texts are joined once, for the chosen branches.

Ids are those of a tree: two trees may use the same ones.

Defined cases: a message with a null id or whose ancestors never reach a root
(orphans, cycles) is in no branch; a null tree_id is a tree of its own; repeated
ids of a tree count once, with the least parent (none before any) and then score,
and the least role and then text; a null score counts as 0, a null role as "user", a
null text as ""; equal mean scores are ranked by longer path, then by the path's ids;
an empty table gives no rows; other columns are not read; texts are formatted whole.
A marker's characters inside a text are escaped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut

TOP = 2
ROLES = ("system", "user", "assistant")


def reply_before(k: Column) -> Column:
    """The k-th turn of a conversation (from 0) replies to the one before it."""
    return k - 1


def reply_halfway(k: Column) -> Column:
    """The k-th turn replies to the last turn up to k // 2 of the other side (sides
    take turns): turn 0 has the replies 1 and 3, turn 1 has 2 and 4, ..., so that
    conversations branch as those with regenerated replies do."""
    half = F.floor(k / 2)
    return half - F.when((k - half) % 2 == 0, 1).otherwise(0)


def bodies_of_turns(conversations: DataFrame) -> DataFrame:
    """(tree_id, turn, message_id, role, text) of a table conv_id, turn, role, text: the
    id of a row is its turn and a digest of role and text."""
    rows = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").alias("tree_id"), "turn", "role", "text")
    which = F.unhex(F.md5(F.concat_ws("\0", F.coalesce("role", F.lit("\1")), F.coalesce("text", F.lit("\1"))))).alias("which")
    return rows.select("tree_id", "turn", F.struct("turn", which).alias("message_id"), "role", "text")


def from_turns(conversations: DataFrame, replies_to: Callable[[Column], Column] = reply_before) -> DataFrame:
    """Messages of a table conv_id, turn, role, text: ``replies_to`` says to which
    turn of its conversation the k-th turn replies.  Different rows of one turn are
    alternatives: siblings, of which the one with the least role and text is
    replied to; equal rows are one message.  The score is the text's length.

    A narrow row a turn is what is numbered; texts are compared only where a turn has
    alternatives."""
    rows = bodies_of_turns(conversations)
    turns = cut(rows.groupBy("tree_id", "turn").agg(F.min("message_id").alias("lo"), F.max("message_id").alias("hi")))
    several = turns.where("lo <> hi").select("tree_id", "turn")
    least = rows.join(several, ["tree_id", "turn"], "left_semi").groupBy("tree_id", "turn").agg(F.min(F.struct("role", "text", "message_id"))["message_id"].alias("least"))
    turns = turns.join(least, ["tree_id", "turn"], "left").select("tree_id", "turn", F.coalesce("least", "lo").alias("first"))
    turns = cut(turns.withColumn("k", F.row_number().over(Window.partitionBy("tree_id").orderBy("turn")) - 1))
    named = turns.select("tree_id", F.col("k").alias("up"), F.col("first").alias("parent_id"))
    parents = turns.select("tree_id", "turn", replies_to(F.col("k")).alias("up")).join(named, ["tree_id", "up"], "left").select("tree_id", "turn", "parent_id")
    return rows.join(parents, ["tree_id", "turn"]).select("tree_id", "message_id", "parent_id", "role", "text", F.char_length("text").cast("double").alias("score"))


def _tree() -> Column:
    """The key of a tree: inside a struct a null tree_id equals itself."""
    return F.struct("tree_id").alias("tree")


def branches(messages: DataFrame) -> DataFrame:
    """(tree_id, path, score) of each root-to-leaf path; score is the mean.

    Self-joins double the reach: of every message its 1st, 2nd, 4th, 8th ...
    ancestor.  From a leaf, the joins with these from the farthest to the nearest
    meet each ancestor once, as each distance is one sum of powers of two.  Only ids
    are joined, and parents' scores once at the end."""
    named = messages.where("message_id IS NOT NULL").select(_tree(), F.col("message_id").alias("node"), F.struct("parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")).alias("m"))
    nodes = cut(named.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.parent_id", "m.score"))
    step = nodes.where("parent_id IS NOT NULL").select("tree", "node", F.col("parent_id").alias("anc"))
    jumps = [cut(step.join(nodes.select("tree", F.col("node").alias("anc")), ["tree", "anc"], "left_semi").select("tree", "node", "anc"))]
    total, reach = nodes.count(), 1
    while reach < total and not jumps[-1].isEmpty():
        far = jumps[-1].select("tree", F.col("node").alias("anc"), F.col("anc").alias("far"))
        jumps.append(cut(jumps[-1].join(far, ["tree", "anc"]).select("tree", "node", F.col("far").alias("anc"))))
        reach *= 2
    leaves = nodes.join(jumps[0].select("tree", F.col("anc").alias("node")), ["tree", "node"], "left_anti")
    # an ancestor as far away as there are messages: the chain runs into a cycle
    if reach >= total:
        leaves = leaves.join(jumps.pop().select("tree", "node"), ["tree", "node"], "left_anti")
    met = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("back"))
    for k in range(len(jumps) - 1, -1, -1):
        more = met.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("anc").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        met = cut(met.unionByName(more))
    scored = met.join(nodes.select("tree", "node", F.col("parent_id").isNull().alias("root"), "score"), ["tree", "node"])
    steps = F.sort_array(F.collect_list(F.struct("back", "node", "score")), asc=False)
    # the farthest message met must be a root
    rooted = F.max(F.struct("back", "root"))["root"]
    paths = scored.groupBy("tree", "leaf").agg(steps.alias("s"), rooted.alias("rooted")).where("rooted")
    total_score = F.aggregate("s.score", F.lit(0.0), lambda a, x: a + x)
    return paths.select("tree.tree_id", F.col("s.node").alias("path"), F.round(total_score / F.size("s"), 6).alias("score"))


def formatted(messages: DataFrame, top: int = TOP, bodies: DataFrame | None = None) -> DataFrame:
    """(tree_id, branch_rank, score, n_messages, conversation): the ``top`` best
    branches of each tree as text.  ``bodies`` (tree_id, message_id, role, text): where
    the texts are, if not to be taken from ``messages``."""
    ranked = branches(messages).withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), F.desc(F.size("path")), "path"))).where(F.col("branch_rank") <= top)
    steps = cut(ranked).select(_tree(), "branch_rank", "score", F.posexplode("path").alias("i", "message_id"))
    own = (messages if bodies is None else bodies).where("message_id IS NOT NULL").select(_tree(), "message_id", F.struct("role", "text").alias("b"))
    body = own.groupBy("tree", "message_id").agg(F.min("b").alias("b")).select("tree", "message_id", "b.role", "b.text")
    role = F.when(F.lower(F.trim("role")).isin(*ROLES), F.lower(F.trim("role"))).otherwise("user")
    turn = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|")), F.lit("\n<|end|>"))
    joined = steps.join(body, ["tree", "message_id"]).select("tree", "branch_rank", "score", F.struct("i", turn.alias("t")).alias("x"))
    lists = joined.groupBy("tree", "branch_rank", "score").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return lists.select("tree.tree_id", F.col("branch_rank").cast("int").alias("branch_rank"), "score", F.size("xs").alias("n_messages"), F.array_join(F.col("xs.t"), "\n").alias("conversation"))
