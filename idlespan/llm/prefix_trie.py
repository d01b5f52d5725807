"""A trie of conversation prefixes from whole sequences.

1. Every conversation is rebuilt: its first ``h`` turns come from the head of its group, the rest are its own.
2. Whole-sequence collapse: identical rebuilt conversations become one weighted sequence, with the list of conversations that end there.
   Only the smallest conversation of a sequence is looked at from here on.
3. Every prefix of a sequence is a row.  Rows with one prefix are a node; sequences that are a proper prefix of another are
   dropped by an anti-join with the nodes that go on, and what is left are the leaves.
4. Weighted prefixes are added up.  A sum over the subtree of a node is a sum over the sequences through it: each gives
   what lies on it from the node's depth to its end.  Weighted by copies that counts members; where a node must count once, it counts
   for its owner, the smallest conversation through it, and what a sequence owns is the end of it, from one depth on.

So no step follows the tree: depth costs rows, not rounds.  A sequence and a prefix are known by 128 bits, the sum of hashes
of (place, sha256 of role and text), taken as four sums of 32 bits; texts never move.

A conversation that holds much of the table is numbered and summed in segments (``scale.running``).  Rows of a prefix that many
sequences share combine in each task, or meet its node in ``SALTS`` groups; the list of ends of a frequent sequence is put together in parts
of at most about ``ENDS_PART`` conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import SEG, TARGET_ROWS, Splits, attach, numbered, plan_splits, running, with_segment
from .store import parts_for, saved, whole_text

GROUP = 5
MOST_SHARED = 8
SALTS = 32
ENDS_PART = 50_000
WORDS = ["w1", "w2", "w3", "w4"]
SEQUENCE, NODE = ["n_turns", *WORDS], ["depth", *WORDS]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def shared_turns(conv: Column) -> Column:
    """How many of its first turns a conversation takes from the head of its group: crc32 of its decimal id modulo 9."""
    return F.crc32(conv.cast("string")) % (MOST_SHARED + 1)


def head_of(conv: Column) -> Column:
    return conv - conv % GROUP


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  texts: bool = False, most_rows: int = TARGET_ROWS) -> DataFrame:
    """Turns in order: ``conv``, ``pos`` from 1, ``digest`` (sha256 of role and text), ``n_bytes`` of the text; written once.

    A null turn number comes first; turns with one number follow in the order of role and digest.  Null role and text are empty.
    Rows without a conversation id belong to none and are left out; other columns are ignored.  ``texts`` keeps ``role`` and ``text``.
    """
    role, text = whole_text(role_col), whole_text(text_col)
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.unhex(digest).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), *[text.alias("text")] * texts)
    splits = plan_splits(rows, "turn", ["conv"], most_rows)
    placed = numbered(rows, ["conv"], ["turn", "role", "digest"], "pos", splits)
    kept = ["digest", "n_bytes", *["role", "text"] * texts]
    return saved(placed.select("conv", (F.col("pos") + 1).alias("pos"), *kept), "turns")


def rebuilt(turns: DataFrame, splits: Splits | None) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the turns of the rebuilt conversations in the columns of ``ordered_turns``."""
    conv = F.col("conv")
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    heads = sizes.select(F.col("conv").alias("head"), F.col("n").alias("n_head"))
    plan = sizes.join(heads, head_of(conv) == F.col("head"), "left").select(
        "conv", (F.least(shared_turns(conv), F.coalesce("n_head", F.lit(0))) - shared_turns(conv)).alias("shift"))
    plan = saved(plan, "conversations")
    kept = [c for c in turns.columns if c not in ("conv", "pos")]
    own = attach(turns.filter(F.col("pos") > shared_turns(conv)), plan, ["conv"], splits, "pos", "inner")
    own = own.select("conv", (F.col("pos") + F.col("shift")).alias("pos"), *kept)
    near = F.array(*[F.try_add(conv, F.lit(i).cast("long")) for i in range(1 - GROUP, GROUP)])
    members = F.filter(near, lambda c: c.isNotNull() & (head_of(c) == conv) & (F.col("pos") <= shared_turns(c)))
    lent = turns.filter((F.col("pos") <= MOST_SHARED) & (conv % GROUP == 0)).select(F.explode(members).alias("conv"), "pos", *kept)
    return plan.select("conv"), own.unionByName(lent.join(plan.select("conv"), "conv", "left_semi"))


def _hashed(turns: DataFrame) -> DataFrame:
    """The four words that a turn adds to the prefixes it lies on."""
    found = {f"h{i}": F.xxhash64(F.lit(i), "pos", "digest") for i in (1, 2)}
    low = F.lit(0xFFFFFFFF).cast("long")
    words = [w for i in (1, 2) for w in (F.shiftrightunsigned(f"h{i}", 32), F.col(f"h{i}").bitwiseAND(low))]
    return turns.withColumns(found).select("conv", "pos", "n_bytes", *[c.alias(w) for c, w in zip(words, WORDS)])


def whole_sequences(convs: DataFrame, hashed: DataFrame) -> DataFrame:
    """Every conversation's whole sequence: ``conv``, its words, ``n_turns`` and ``total`` bytes; turnless ones have zeros."""
    sums = hashed.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("n_bytes").alias("total"), *[F.sum(w).alias(w) for w in WORDS])
    return convs.join(sums, "conv", "left").fillna(0, ["total", *SEQUENCE])


def collapsed(whole: DataFrame) -> DataFrame:
    """Identical conversations as one: the sequence, its smallest ``conv``, its ``weight`` (conversations) and ``total`` bytes."""
    return whole.groupBy(*SEQUENCE).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total"))


def end_lists(whole: DataFrame, part: int = ENDS_PART) -> DataFrame:
    """Which conversations end at a sequence: ascending ``ids`` in parts ``_seg``, each from a range of at most about ``part`` conversations."""
    n = whole.count()
    if n > part:
        segments = parts_for(n, part)
        points = whole.select(F.col("conv").cast("double").alias("conv")).approxQuantile(
            "conv", [i / segments for i in range(1, segments)], 1 / (4 * segments))
        whole = with_segment(whole, "conv", Splits(tuple(sorted(set(points)))))
    else:
        whole = whole.withColumn(SEG, F.lit(0))
    return whole.groupBy(*SEQUENCE, SEG).agg(F.sort_array(F.collect_list("conv")).alias("ids"))


def end_digests(lists: DataFrame) -> DataFrame:
    """``ends_sha256`` of every sequence: its conversations in order, comma-joined.  A list in several parts is streamed part by part."""
    parts = saved(lists.select(*SEQUENCE, SEG, F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")), "ends")
    counted = parts.groupBy(*SEQUENCE).agg(F.count(F.lit(1)).alias("parts"), F.max("ids").alias("ids"))
    short = counted.filter("parts = 1").select(*SEQUENCE, F.sha2("ids", 256).alias("ends_sha256"))
    names = [*SEQUENCE, "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in SEQUENCE)))
            for key, ids in zip(keys, batch.column("ids")):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(ids.as_buffer())
        if now is not None:
            out.append((*now, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
    long = parts.join(counted.filter("parts > 1").select(*SEQUENCE), SEQUENCE, "left_semi")
    streamed = long.repartition(*SEQUENCE).sortWithinPartitions(*SEQUENCE, SEG).select(*SEQUENCE, "ids").mapInArrow(
        run, ", ".join([*[f"{c} long" for c in SEQUENCE], "ends_sha256 string"]))
    return short.unionByName(streamed)


def prefixes(hashed: DataFrame, sequences: DataFrame, splits: Splits | None) -> DataFrame:
    """Every prefix of every different sequence, the empty one too: ``conv``, ``weight``, ``n_turns``, the node (``depth`` and words), and
    the bytes of the turns ``before`` its last one."""
    kept = sequences.select("conv", "weight", "n_turns")
    rows = attach(hashed, kept, ["conv"], splits, "pos", "inner")
    sums = {f"_{c}": ("sum", F.col(c)) for c in ("n_bytes", *WORDS)}
    along = running(rows, ["conv"], ["pos"], sums, splits=splits)
    found = along.select("conv", "weight", "n_turns", F.col("pos").alias("depth"), *[F.col(f"_{w}").alias(w) for w in WORDS],
                         (F.col("_n_bytes") - F.col("n_bytes")).alias("before"), F.col("_n_bytes").alias("upto"))
    zero = F.lit(0).cast("long")
    return found.unionByName(kept.withColumns({c: zero for c in (*NODE, "before", "upto")}))


def _owned(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where each sequence starts to own its nodes: ``conv``, ``first`` (depth; null if it owns no node that others share), ``first_before``,
    the ``deepest`` shared node with the bytes ``deep_upto`` its end, and ``above``, the owner of the node over the first one.

    Owners only grow along a sequence, and from some depth on nobody shares its nodes.
    """
    shared = nodes.filter("n_sequences > 1").select(*NODE, "owner")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)))
    met = salted.select(*NODE, "_salt").distinct().join(shared, NODE)
    own = F.col("owner") == F.col("conv")
    return salted.join(met, [*NODE, "_salt"]).groupBy("conv").agg(
        F.min(F.when(own, F.col("depth"))).alias("first"), F.min(F.when(own, F.col("before"))).alias("first_before"),
        F.max("depth").alias("deepest"), F.max("upto").alias("deep_upto"), F.max(F.when(~own, F.col("owner"))).alias("above"))


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
         most_rows: int = TARGET_ROWS, ends_part: int = ENDS_PART) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``, and ``w1`` to ``w4``, which with ``depth`` name the node.

    Nulls, ties and other columns are treated as in ``ordered_turns``.  Repeated rows are turns of their own.  A rebuilt conversation
    without turns is a member of the root alone.  No conversations give no rows, not even a root.  Long texts are read once, for
    their digest.
    """
    ordered = ordered_turns(turns, conv_col, turn_col, role_col, text_col, most_rows=most_rows)
    splits = plan_splits(ordered, "pos", ["conv"], most_rows)
    convs, found = rebuilt(ordered, splits)
    hashed = saved(_hashed(found), "rebuilt")
    whole = saved(whole_sequences(convs, hashed), "whole")
    sequences = saved(collapsed(whole), "sequences")
    rows = saved(prefixes(hashed, sequences, splits), "prefixes")
    nodes = saved(rows.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_sequences"),
                                          F.max(F.col("n_turns") > F.col("depth")).alias("goes_on")), "nodes")
    proper = nodes.filter("goes_on").select(F.col("depth").alias("n_turns"), *WORDS)
    leaves = sequences.join(proper, SEQUENCE, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    fresh = F.coalesce(F.col("deepest") + 1, F.lit(0).cast("long"))               # the first node that nobody shares
    first = F.coalesce("first", F.when(fresh <= F.col("n_turns"), fresh))
    marks = saved(sequences.select("conv", "total", "n_turns").join(leaves, "conv", "left").join(_owned(rows, nodes), "conv", "left").select(
        "conv", "total", F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"), first.alias("first"),
        F.coalesce("first_before", "deep_upto", F.lit(0).cast("long")).alias("first_before"), "above"), "marks")
    depth, at = F.col("depth"), F.col("first")
    rest = F.col("total") - F.col("before")
    owned = F.when(at.isNull(), 0).when(depth >= at, rest).otherwise(F.col("total") - F.col("first_before"))
    parent = F.when(depth > at, F.col("conv")).when(depth > 0, F.col("above"))
    sums = attach(rows, marks, ["conv"], splits, "depth", "inner").groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.min_by(parent, "conv").alias("parent_conv_id"), F.sum("weight").alias("n_convs"),
        (F.sum(F.when(at == depth + 1, 1).otherwise(0)) + F.min_by((F.col("n_turns") > depth).cast("long"), F.col("conv"))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * rest - owned).alias("saved_tokens"))
    ends = end_digests(end_lists(whole, ends_part)).withColumnRenamed("n_turns", "depth")
    return sums.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), *WORDS)


def last_turns(nodes: DataFrame, turns: DataFrame, most_rows: int = TARGET_ROWS, **columns: str) -> DataFrame:
    """``role`` and ``text`` of the last turn of every node but the root: nodes meet their smallest member's turn by (conversation, place)."""
    ordered = ordered_turns(turns, texts=True, most_rows=most_rows, **columns)
    found = rebuilt(ordered, plan_splits(ordered, "pos", ["conv"], most_rows))[1]
    return nodes.join(found.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "role", "text"), ["conv_id", "depth"])
