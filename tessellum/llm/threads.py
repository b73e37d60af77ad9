"""Rebuilding conversations from message rows (problem 3).

Parent pointers are resolved by pointer jumping: every round joins the pointer table to itself and doubles the length of
each pointer, so a path of n nodes needs about log2(n) rounds. Two kinds of pointer exist here:

* a message's parent is the message before it in its conversation. Messages are range-partitioned by their whole sort
  key into blocks of bounded size, so a conversation that fills a third of the table spreads over many blocks; inside a
  block the pointers are contracted by a window, and only the block heads jump. A path's length from its root is the
  message's position in the ordered conversation.
* a TOOL_RESPONSE's parent is the TOOL row that made its call. A response without such a row is an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.session import forget, materialize

#: Roles in the order that they take at equal times.
ROLES = ("SYSTEM", "USER", "TOOL", "TOOL_RESPONSE", "ASSISTANT")
#: Fixed value: what the chat service appends to an answer whose stream broke.
MARKER = "[TRUNCATED DUE TO ERROR]"
#: White space, control and format characters, and the letters and marks that show nothing.
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]"


def pointer_jump(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Resolve parent pointers. ``nodes`` (id, parent, weight) -> (id, root, dist, status).

    ``dist`` is the sum of the weights of the nodes above (a root has 0). ``status`` is ``ok``, ``orphan`` where the
    path ends at a parent that is no node, or ``cycle`` where it never ends; both have a null root and dist. Ids must
    be unique and not null; a null parent makes a root. Repeated (id, parent) rows count once. Each round is one
    self-join, written to the shared folder; a cycle is what still moves after log2(number of nodes) + 1 rounds.
    """
    nodes = nodes.select("id", "parent", "weight").dropDuplicates(["id"])
    ids = nodes.select(F.col("id").alias("pid"), F.col("weight").alias("pw"))
    state = nodes.join(ids, nodes.parent == ids.pid, "left").select(
        "id",
        F.when(F.col("pid").isNotNull(), F.col("pid")).alias("up"),
        F.coalesce("pw", F.lit(0)).cast("long").alias("dist"),
        F.when(F.col("pid").isNotNull() | F.col("parent").isNull(), F.lit("ok")).otherwise("orphan").alias("status"),
        F.col("id").alias("root"),
    )
    state = materialize(state, "jump")
    total = state.count()
    for _ in range(min(max_rounds, max(total, 1).bit_length() + 1)):
        if state.where(F.col("up").isNotNull()).isEmpty():
            break
        above = state.select(F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("dist").alias("a_dist"), F.col("status").alias("a_status"), F.col("root").alias("a_root"))
        moved = state.where(F.col("up").isNotNull()).join(above, F.col("up") == F.col("a_id")).select(
            "id", F.col("a_up").alias("up"), (F.col("dist") + F.col("a_dist")).alias("dist"), F.col("a_status").alias("status"), F.col("a_root").alias("root")
        )
        last, state = state, materialize(state.where(F.col("up").isNull()).unionByName(moved), "jump")
        forget(last)
    cyclic = F.col("up").isNotNull()
    status = F.when(cyclic, "cycle").otherwise(F.col("status"))
    ok = status == "ok"
    return state.select("id", F.when(ok, F.col("root")).alias("root"), F.when(ok, F.col("dist")).alias("dist"), status.alias("status"))


def visible(content: Column) -> Column:
    """Whether anything but white space, invisible characters and the service's marker is left of a content."""
    return F.length(F.regexp_replace(F.replace(F.coalesce(content, F.lit("")), F.lit(MARKER), F.lit("")), INVISIBLE, "")) > 0


def clean_messages(messages: DataFrame) -> DataFrame:
    """One row per message id at its earliest time, with the clean role, its rank and visibility.

    Rows of one id that differ elsewhere give the values of the earliest row (ties: the smallest values). Null ids are
    taken as one message per distinct row; rows without conversation_id belong to none and are left out. The
    reduction is a partial ``min``, so repeated ids shrink before the shuffle.
    """
    m = messages.where(F.col("conversation_id").isNotNull()).select("id", "conversation_id", "role", "content", "tool_call_id", "created_at")
    ident = F.coalesce("id", F.concat(F.lit("?"), F.sha2(F.to_json(F.struct("conversation_id", "role", "content", "tool_call_id", "created_at")), 256)))
    row = F.struct(F.col("created_at").isNull().alias("late"), "created_at", "conversation_id", "role", "content", "tool_call_id")
    one = m.select(ident.alias("id"), row.alias("row")).groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")
    role = F.upper(F.regexp_replace(F.coalesce("role", F.lit("")), r"^\s+|\s+$", ""))
    return one.select(
        "id", "conversation_id", "content", "tool_call_id", "created_at", role.alias("role"),
        F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), role).cast("int"), F.lit(0)).alias("rank"),
        visible(F.col("content")).alias("visible"),
    )


def _order() -> list[Column]:
    return [F.col("created_at").asc_nulls_first(), F.when(F.col("rank") == 0, 9).otherwise(F.col("rank")), F.col("id")]


def blocks(clean: DataFrame, bytes_per_block: int = 128 << 20) -> DataFrame:
    """``clean`` plus ``block``: rows are range-partitioned by conversation and order, so blocks are runs of bounded size.

    A block holds some ``bytes_per_block`` of contents, as a task does. The result is written once, so that a block's
    number never changes when an executor is lost.
    """
    size = clean.agg(F.sum(F.coalesce(F.octet_length("content"), F.lit(0)) + 200)).first()[0] or 0
    parts = max(int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // bytes_per_block)
    ranged = clean.repartitionByRange(parts, F.col("conversation_id"), *_order())
    return materialize(ranged.withColumn("block", F.spark_partition_id()), "blocks")


def _heads(blocked: DataFrame) -> DataFrame:
    """(conversation_id, block, first, n, up): each block of a conversation, pointing to the one before."""
    heads = blocked.groupBy("conversation_id", "block").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conversation_id").orderBy("block")  # at most one row per range partition
    return heads.withColumn("up", F.lag("block").over(w))


def positions(blocked: DataFrame) -> DataFrame:
    """``blocked`` plus ``position`` in the conversation: in-block rank plus the distance of the block's head from the root."""
    name = lambda b: F.concat_ws("#", "conversation_id", F.col(b))
    heads = materialize(_heads(blocked).select("conversation_id", "block", name("block").alias("id"), F.when(F.col("up").isNotNull(), name("up")).alias("parent"), F.col("n").alias("weight")), "heads")
    jumped = pointer_jump(heads).join(heads.select("id", "conversation_id", "block"), "id").select("conversation_id", "block", "dist")
    w = Window.partitionBy("conversation_id", "block").orderBy(*_order())
    return blocked.withColumn("in_block", F.row_number().over(w) - 1).join(jumped, ["conversation_id", "block"]).withColumn("position", (F.col("dist") + F.col("in_block")).cast("long")).drop("dist", "in_block")


def calls(clean: DataFrame) -> DataFrame:
    """(conversation_id, call_id) whose call and responses do not fit: an orphan response, one before its call, or none.

    Responses are pointed to the call row they name; pointers that end in no call are orphans. Call ids are aggregated
    before the shuffle, so one id may be named by any number of rows.
    """
    key = F.struct("created_at", "rank", "id")
    made = clean.where("role = 'TOOL'").select(
        "conversation_id", F.explode(F.from_json("content", "array<struct<id:string>>")).alias("c"), key.alias("at"), F.lit(None).cast("struct<created_at:timestamp_ntz,rank:int,id:string>").alias("answered")
    ).select("conversation_id", F.col("c.id").alias("call_id"), "at", "answered")
    named = clean.where("role = 'TOOL_RESPONSE'").select("conversation_id", F.col("tool_call_id").alias("call_id"), F.lit(None).cast("struct<created_at:timestamp_ntz,rank:int,id:string>").alias("at"), key.alias("answered"))
    fit = made.unionByName(named).groupBy("conversation_id", "call_id").agg(F.min("at").alias("at"), F.min("answered").alias("answered"))
    return fit.where(F.col("call_id").isNull() | F.col("at").isNull() | F.col("answered").isNull() | (F.col("answered") < F.col("at")))


def loose(blocked: DataFrame) -> DataFrame:
    """(conversation_id) of conversations with a pointer that ends in an orphan or a cycle.

    A response points to the call that it names, a call to its block, and a block to the one before, all resolved by
    ``pointer_jump``. The messages of a block are contracted to its head, and the calls and responses of one call id to
    one node each, before the jump.
    """
    name = lambda kind, c: F.to_json(F.array(F.col("conversation_id"), F.lit(kind), F.col(c).cast("string")))
    heads = _heads(blocked).select(name("block", "block").alias("id"), F.when(F.col("up").isNotNull(), name("block", "up")).alias("parent"), F.col("n").alias("weight"))
    made = blocked.where("role = 'TOOL'").select("conversation_id", "block", F.explode(F.from_json("content", "array<struct<id:string>>")).alias("c")).select("conversation_id", "block", F.col("c.id").alias("call_id"))
    made = made.groupBy("conversation_id", "call_id").agg(F.min("block").alias("block")).select(name("call", "call_id").alias("id"), name("block", "block").alias("parent"), F.lit(0).alias("weight"))
    named = blocked.where("role = 'TOOL_RESPONSE'").select("conversation_id", "tool_call_id").distinct().select(name("response", "tool_call_id").alias("id"), name("call", "tool_call_id").alias("parent"), F.lit(0).alias("weight"))
    nodes = materialize(heads.unionByName(made).unionByName(named), "nodes")
    return pointer_jump(nodes).where("status <> 'ok'").select(F.from_json("id", "array<string>")[0].alias("conversation_id")).distinct()


def unanswered(blocked: DataFrame) -> DataFrame:
    """Conversations with a user turn that gets no visible reply before the next turn or the end.

    Only three kinds of row matter: U (visible USER), A (visible ASSISTANT) and x (any other ASSISTANT, TOOL or
    TOOL_RESPONSE row, which only ends a turn). U followed by the end, or by U with an x between, is a turn without
    reply. Each block is summarised by its first and last U/A and the x around them, and the few summaries of a
    conversation are joined in order; no conversation is ever gathered in one task.
    """
    kind = F.when((F.col("role") == "USER") & F.col("visible"), "U").when((F.col("role") == "ASSISTANT") & F.col("visible"), "A").when(F.col("role").isin("ASSISTANT", "TOOL", "TOOL_RESPONSE"), "x")
    ev = blocked.select("conversation_id", "block", *["created_at", "rank", "id"], kind.alias("kind")).where(F.col("kind").isNotNull())
    w = Window.partitionBy("conversation_id", "block").orderBy(*_order())
    ev = ev.withColumn("n", F.row_number().over(w)).withColumn("xs", F.sum((F.col("kind") == "x").cast("int")).over(w))
    ua = ev.where("kind <> 'x'")
    wb = Window.partitionBy("conversation_id", "block").orderBy("n")
    bad = (F.col("kind") == "U") & (F.lag("kind").over(wb) == "U") & (F.lag("xs").over(wb) < F.col("xs"))
    inner = ua.withColumn("bad", F.coalesce(bad, F.lit(False))).groupBy("conversation_id", "block").agg(
        F.min_by("kind", "n").alias("first"), F.max_by("kind", "n").alias("last"), F.min("xs").alias("x_before"), F.max("xs").alias("x_upto"), F.max("bad").alias("bad")
    )
    total = ev.groupBy("conversation_id", "block").agg(F.max("xs").alias("x_all"))
    s = total.join(inner, ["conversation_id", "block"], "left").select(
        "conversation_id", "block", "first", "last", F.coalesce("bad", F.lit(False)).alias("bad"),
        F.coalesce("x_before", "x_all").alias("x_before"), F.coalesce(F.col("x_all") - F.col("x_upto"), F.lit(0)).alias("x_after"),
    )
    wc = Window.partitionBy("conversation_id").orderBy("block")  # at most one row per range partition
    # x rows seen up to the first U/A of this block, and up to the last U/A before it
    s = s.withColumn("upto_first", F.coalesce(F.sum(F.when(F.col("first").isNull(), F.col("x_before")).otherwise(F.col("x_before") + F.col("x_after"))).over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("x_before"))
    s = s.where(F.col("first").isNotNull()).withColumn("upto_last", F.col("upto_first"))
    seam = (F.col("first") == "U") & (F.lag("last").over(wc) == "U") & (F.lag("upto_last").over(wc) < F.col("upto_first"))
    end = F.lead("last").over(wc).isNull() & (F.col("last") == "U")
    return s.withColumn("open", F.col("bad") | F.coalesce(seam, F.lit(False)) | end).where("open").select("conversation_id").distinct()


def judge_conversations(clean: DataFrame, blocked: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, defect) of every conversation, defect null where it is kept.

    The first of ``empty``, ``broken`` and ``missing_reply`` that holds. Conversations are those of the conversations
    table (null ids aside, repeats once) and those named by messages.
    """
    key = F.struct(*[c for c in (F.col("created_at"), F.col("rank"), F.col("id"))])
    speaks = F.col("visible") & F.col("role").isin("USER", "ASSISTANT")
    facts = clean.groupBy("conversation_id").agg(
        F.max(speaks).alias("speaks"),
        F.max(F.col("rank") == 0).alias("odd_role"),
        F.max(F.col("created_at").isNull()).alias("no_time"),
        F.min(F.when(F.col("visible") & (F.col("role") == "USER"), key)).alias("first_user"),
        F.min(F.when(F.col("visible") & ~F.col("role").isin("USER", "SYSTEM"), key)).alias("first_other"),
    )
    known = conversations.where(F.col("id").isNotNull()).select(F.col("id").alias("conversation_id")).distinct().withColumn("known", F.lit(True))
    # orphans and cycles by pointer jumping; the aggregates of calls() add calls without response and responses before their call
    misfit = calls(clean).select("conversation_id").unionByName(loose(blocked)).distinct().withColumn("misfit", F.lit(True))
    silent = unanswered(blocked).withColumn("silent", F.lit(True))
    j = facts.join(known, "conversation_id", "full").join(misfit, "conversation_id", "left").join(silent, "conversation_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    early = F.col("first_other").isNotNull() & (F.col("first_user").isNull() | (F.col("first_other") < F.col("first_user")))
    broken = F.col("known").isNull() | no(F.col("odd_role")) | no(F.col("no_time")) | no(early) | F.col("misfit").isNotNull()
    defect = F.when(~no(F.col("speaks")), "empty").when(broken, "broken").when(F.col("silent").isNotNull(), "missing_reply")
    return j.select("conversation_id", defect.alias("defect"))


def rebuild(messages: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordered messages of the kept conversations, judgement of all conversations).

    The messages are (conversation_id, position, id, role, content, tool_call_id, created_at). Empty tables give
    empty results; extra columns are ignored; a blank role or content is an unknown role or an invisible message.
    """
    blocked = blocks(materialize(clean_messages(messages), "clean"))  # read by a count, a range sample and a sort
    judged = materialize(judge_conversations(blocked, blocked, conversations), "judged")
    kept = judged.where(F.col("defect").isNull()).select("conversation_id")
    ordered = positions(blocked.join(kept, "conversation_id", "left_semi"))
    return ordered.select("conversation_id", "position", "id", "role", "content", "tool_call_id", "created_at"), judged
