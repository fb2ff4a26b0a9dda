"""Prefix trie of conversations by block digests.

A prefix of turns has a digest that is the XOR of one hash a turn and place, so prefixes can be formed in parts.
Conversations are cut into blocks of a fixed number of turns and grouped by the digests at the block ends
first: what they share in whole blocks costs a row a block. Only blocks that have siblings below the same prefix
are opened, and there it is their distinct contents that are grouped turn by turn.

Sums over subtrees go along paths. The nodes whose smallest member is one conversation form a path that
hangs on a node of another one, so whole paths are added up over the tree of conversations by pointer doubling,
and sums from the end of a path give the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.postings import numbered
from ..session import materialize
from ..sizing import lookup_join, split_hot_join

#: Turns of a block, and turns of a conversation that one task puts in order.
BLOCK, PIECE = 8, 4096
#: Ids of a packet of members.
PACKET = 65_536
_KEY = ["depth", "s1", "s2"]
_NODE = "depth long, s1 long, s2 long"


def running(df: DataFrame, key: str, place: str, columns: list[str], fold: Callable[[str], Column], join: Callable[[Column, Column], Column], reverse: bool = False) -> DataFrame:
    """``df`` with each of ``columns`` folded over the rows of ``key`` up to its own, by ``place`` (from 0 or 1).

    A key is folded in pieces of PIECE places; where a key has several, what the earlier ones add up to is joined on.
    """
    order = F.desc if reverse else F.asc
    cut = df.withColumn("_piece", F.floor(F.col(place) / PIECE).cast("long"))
    inside = Window.partitionBy(key, "_piece").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(cut.select("*", *[fold(c).over(inside).alias(f"_{c}") for c in columns]), "running")
    long = local.where("_piece > 0").select(key).distinct()
    if long.isEmpty():
        return local.drop("_piece", *columns).withColumnsRenamed({f"_{c}": c for c in columns})
    totals = lookup_join(local, long, key, "left_semi", spread_on=place).groupBy(key, "_piece").agg(*[fold(c).alias(c) for c in columns])
    earlier = Window.partitionBy(key).orderBy(order("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select(key, "_piece", *[fold(c).over(earlier).alias(f"_before_{c}") for c in columns]), "offsets")
    joined = lookup_join(local, offsets, [key, "_piece"], "left", spread_on=place)
    folded = [join(F.col(f"_{c}"), F.coalesce(f"_before_{c}", F.lit(0))).alias(c) for c in columns]
    return joined.select(*[c for c in df.columns if c not in columns], *folded)


def numbered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conv_id, n, digest, chars)`` of all turns, and ``(conv_id, start, own)`` of all conversations.

    ``n`` counts the turns of the whole table in order, ``start`` is that of a conversation's first turn and
    ``own`` the number of its turns. Missing turn numbers come first; equal ones go by role, then by digest.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")
    )
    placed = numbered(rows, "conv_id", "turn", "role", "digest").select("conv_id", "n", "digest", "chars")
    return placed, placed.groupBy("conv_id").agg(F.min("n").alias("start"), F.count(F.lit(1)).alias("own"))


def with_shared_heads(placed: DataFrame, convs: DataFrame, head: Column, donor: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, pos, digest, chars)``, and all ``conv_id``, after heads are taken from other conversations.

    The first ``head`` turns of a conversation, at most ``most``, become those of conversation ``donor``: all it has
    if it has fewer, none if there is no such conversation.
    """
    wants = materialize(convs.select("conv_id", "start", "own", head.cast("long").alias("h"), donor.cast("long").alias("donor")), "convs")
    given = wants.select(F.col("conv_id").alias("donor"), F.col("own").alias("has"))
    wants = materialize(wants.join(given, "donor", "left").withColumn("given", F.least("h", F.coalesce("has", F.lit(0)))).drop("own", "has"), "heads")
    spots = wants.select("conv_id", "start", "h", "given")
    turns = split_hot_join(placed, spots, ["conv_id"], "inner", "n", stored=True).withColumn("pos", F.col("n") - F.col("start") + 1)
    turns = materialize(turns.select("conv_id", "pos", "h", "given", "digest", "chars"), "turns")
    donors = turns.where(F.col("pos") <= most).select(F.col("conv_id").alias("donor"), "pos", "digest", "chars")
    heads = donors.join(wants.where("given > 0").select("conv_id", "donor", "given"), "donor").where("pos <= given").select("conv_id", "pos", "digest", "chars")
    rest = turns.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "digest", "chars")
    return heads.unionByName(rest), wants.select("conv_id")


def _member_digests(ends: DataFrame) -> DataFrame:
    """``(depth, s1, s2, ends_sha256)`` of nodes at which conversations end.

    Ids are sorted over all tasks and joined to packets there; a digest only passes over the packets of its node.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
        """Rows of equal key, batch by batch."""
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys, at = list(zip(*columns[:3])), 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    yield keys[at], columns[3:], slice(at, i)
                    at = i

    def table(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()]
        for key, (ids,), at in runs(batches):
            for a in range(at.start, at.stop, PACKET):
                part = ids[a : min(a + PACKET, at.stop)]
                yield table([(*key, part[0], ",".join(map(str, part)))], [*_KEY, "low", "ids"], kinds)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, now, sha = [pa.int64()] * 3 + [pa.string()], None, None
        for key, (_, ids), at in runs(batches):
            if key != now:
                if now is not None:
                    yield table([(*now, sha.hexdigest())], [*_KEY, "ends_sha256"], kinds)
                now, sha, first = key, hashlib.sha256(), True
            for part in ids[at]:
                sha.update(part.encode() if first else b"," + part.encode())
                first = False
        if now is not None:
            yield table([(*now, sha.hexdigest())], [*_KEY, "ends_sha256"], kinds)

    order = [*_KEY, "conv_id"]
    packets = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, f"{_NODE}, low long, ids string")
    return packets.repartition(*_KEY).sortWithinPartitions(*_KEY, "low").mapInArrow(digest, f"{_NODE}, ends_sha256 string")


def _nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(depth, s1, s2, u1, u2, chars, n_convs, conv_id)`` of all nodes with the digest above, and ``(conv_id, depth, s1, s2)`` of all ends."""
    z1, z2 = F.xxhash64("digest", "pos"), F.xxhash64("pos", "digest")
    hashed = turns.select("conv_id", "pos", "chars", z1.alias("z1"), z2.alias("z2"), z1.alias("s1"), z2.alias("s2"))
    prefixes = running(hashed, "conv_id", "pos", ["s1", "s2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    u1, u2 = F.col("s1").bitwiseXOR(F.col("z1")), F.col("s2").bitwiseXOR(F.col("z2"))
    turn = F.struct(F.col("pos").alias("depth"), "s1", "s2", u1.alias("u1"), u2.alias("u2"), "chars")
    block = F.floor((F.col("pos") - 1) / BLOCK).cast("long").alias("block")
    blocks = prefixes.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    last, first = F.element_at("turns", -1), F.col("turns")[0]
    blocks = materialize(blocks.select("conv_id", "turns", *[last[c].alias(c) for c in _KEY]), "blocks")
    shared = blocks.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
    shared = materialize(shared.select("*", first["u1"].alias("u1"), first["u2"].alias("u2"), (first["depth"] - 1).alias("above")), "shared")
    siblings = shared.groupBy("above", "u1", "u2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_KEY)).alias("only"))
    alone = siblings.where("n = 1").select("only.*")
    whole = ["n_convs", "conv_id", F.inline("turns")]
    closed = shared.join(alone, _KEY, "left_semi").select(*whole)
    opened = shared.join(alone, _KEY, "left_anti").select(*whole).groupBy(*_KEY)
    opened = opened.agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("u1", "u2", "chars")])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select("*", *[zero.alias(c) for c in (*_KEY, "chars")], none.alias("u1"), none.alias("u2"))
    nodes = materialize(closed.unionByName(opened).unionByName(root), "nodes")
    ends = blocks.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("end")).select("conv_id", "end.*")
    ends = convs.join(ends, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in _KEY])
    return nodes, materialize(ends, "ends")


def _paths(nodes: DataFrame) -> DataFrame:
    """``(conv_id, first, last, saved, parent)``: the path of nodes that belong to a conversation, and the owner of the node above it."""
    saved = (F.col("n_convs") - 1) * F.col("chars")
    up = F.min_by(F.struct(F.col("u1").alias("s1"), F.col("u2").alias("s2")), "depth").alias("up")
    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max("depth").alias("last"), F.sum(saved).alias("saved"), up)
    paths = materialize(paths.select("conv_id", "first", "last", "saved", (F.col("first") - 1).alias("depth"), "up.*"), "paths")
    owners = nodes.select(*_KEY, F.col("conv_id").alias("parent"))
    return materialize(split_hot_join(paths, owners, _KEY, "left", "conv_id", stored=True).drop(*_KEY), "tree")


def _whole_paths(paths: DataFrame) -> DataFrame:
    """``(conv_id, leaves, saved)``: sums over the path of a conversation and all that hangs on it.

    After k rounds a row has the sum of what is less than 2^k paths below, and points 2^k paths up.
    """
    taken = paths.select(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("last")).distinct().withColumn("taken", F.lit(1))
    state = paths.join(taken, ["conv_id", "last"], "left").select("conv_id", F.col("parent").alias("up"), F.when(F.col("taken").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved")
    state = materialize(state, "sums")
    top = state.where("up IS NULL").select("conv_id").first()
    while not (live := state.where("up IS NOT NULL")).isEmpty():
        below = live.groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        inner = live.where(F.col("up") != top[0]).select("conv_id", "up")  # what points at the top is done
        next_ = split_hot_join(inner, state.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), ["up"], "inner", "conv_id", stored=True)
        state = state.drop("up").join(below, "conv_id", "left").join(next_.select("conv_id", F.col("next").alias("up")), "conv_id", "left")
        state = state.select("conv_id", "up", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        state = materialize(state, "sums")
    return state.drop("up")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``(conv_id, pos, digest, chars)`` with ``pos`` from 1 without gaps, ``convs`` every ``conv_id`` once,
    those without turns too. ``conv_id`` of a node is its smallest member; ``ends_sha256`` digests the ids of the
    members that end there. No conversations give no rows, not even a root.
    """
    nodes, ends = _nodes(turns, convs)
    paths = _paths(nodes)
    none = F.lit(None).cast("long")
    hung = paths.where("parent IS NOT NULL").drop("saved").join(_whole_paths(paths), "conv_id")
    hung = hung.groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    zeros = [F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")]
    marks = hung.select("conv_id", "depth", "kids", "leaves", "saved", none.alias("up"), F.lit(False).alias("first"), F.lit(False).alias("last"))
    marks = marks.unionByName(paths.select("conv_id", F.col("first").alias("depth"), *zeros, F.col("parent").alias("up"), F.lit(True).alias("first"), F.lit(False).alias("last")))
    marks = marks.unionByName(paths.select("conv_id", F.col("last").alias("depth"), *zeros, none.alias("up"), F.lit(False).alias("first"), F.lit(True).alias("last")))
    marks = marks.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")], *[F.max(c).alias(c) for c in ("up", "first", "last")])
    marked = nodes.join(marks, ["conv_id", "depth"], "left").fillna(0, ["kids", "leaves", "saved"]).fillna(False, ["first", "last"])
    leaf = (F.col("last") & (F.col("kids") == 0)).cast("long")
    marked = marked.select(
        "conv_id", *_KEY, "n_convs", F.when(F.col("first"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        (F.col("kids") + (~F.col("last")).cast("long")).alias("n_children"), (F.col("leaves") + leaf).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    summed = running(marked, "conv_id", "depth", ["n_leaves", "saved_tokens"], F.sum, lambda a, b: a + b, reverse=True)
    out = summed.join(_member_digests(ends), _KEY, "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def conversation_trie(turns: DataFrame, head: Column | None = None, donor: Column | None = None, most: int = 5, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of ``prefix_trie`` over a table of turns, one row a turn.

    With ``head`` and ``donor``, columns over ``conv_id``, the first turns of each conversation are replaced first, see
    ``with_shared_heads``. Null roles and texts count as empty. Turns go by number, nulls first; equal numbers,
    repeated rows too, by role and then by digest, each row a turn of its own. Rows with a null id are no
    conversation and are left out. An empty table gives no rows; other columns are not looked at. No group grows with a hot
    id or prefix: long conversations are folded in pieces, and members of a node are joined to packets by all tasks
    before the one that digests them passes over those.
    """
    placed, convs = numbered_turns(turns, id_col, turn_col, role_col, text_col)
    if head is None:
        head, donor = F.lit(0), F.col("conv_id")
    return prefix_trie(*with_shared_heads(placed, convs, head, donor, most))
