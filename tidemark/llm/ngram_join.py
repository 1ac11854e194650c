"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct word 5-grams; two documents link at Jaccard >= 0.8. Steps:

1. **Sets.** One pass over the texts hashes the shingles (48 bits: by chance two of a pair of 500-shingle sets
   agree once in about a billion pairs) and writes the sorted sets.
   Documents with equal sets form one class and only one of them goes on.
2. **Groups.** Classes that share a minimum under one of six hash orders are checked against
   four drawn leaders with that minimum, if they agree in three orders at least. The components of the links so found are groups; a class
   without such a link joins those that share its commonest minimum. Large groups are cut in
   blocks of about 16 to 32.
3. **Token-group matrix.** Under one order of all shingles (frequent ones last) similar sets
   share a shingle among their first ``n - ceil(0.8 n) + 1``. The union of these shingles over a
   group is its row of the matrix, kept as (shingle, group, block, sizes). A query meets the
   groups that share such a shingle and whose sizes allow the threshold.
4. **Bound and open.** Each set has parity bits, about one a shingle: those of two sets differ in no more places than
   the sets differ in shingles, which bounds their overlap. Queries that pass this bound for some
   member of a block go on with their whole sets. For a block the union of its whole sets is formed; if its overlap with the
   query cannot reach the threshold the block stays shut, otherwise the query is counted against
   each member. Of its links to one connected part of a block one is kept, so the components come
   out whole without all pairs of a group.

Of two groups the smaller asks the larger, so a third of all rows in one group costs a
fixed number of leader checks per row. The order of shingles only decides how few candidates there are, never which
links are found: counts come from all texts, with those below ``2**-22`` of all shingles
treated alike, so at most ``2**22`` frequent shingles reach the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import Scratch, components, release

WIDTH = 5
PERCENT = 80
BLOCK = 32
PARITIES = 1024  # at least; a set has as many as shingles, rounded up to a power of two
QUERIES_PER_TASK_BLOCK = 256
ORDERS = 6
LEADERS = 4
AGREEING = 3  # orders in which a class and a leader must have the same minimum
COUNTED = 1 << 22  # shingles counted together in a task
FREQUENT = 1 << 22  # most frequent shingles that can reach the tasks, 12 bytes each
LEAST_FREQUENT = 16
SALTS = 64  # tasks that the rows of a frequent shingle are dealt to
KEPT_BITS = np.uint64((1 << 48) - 1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


_SALTS = np.arange(ORDERS, dtype=np.uint64) * _MIX[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no word gives none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(width, len(words))
    g = h[: len(h) - span + 1].copy()
    for i in range(1, span):
        g = mixed(g) + h[i : len(h) - span + 1 + i] * _MIX[0]
    g = mixed(g + np.uint64(span)) & KEPT_BITS
    g.sort()
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


def packed(tokens: np.ndarray) -> bytes:
    """Six bytes a shingle."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def parities(tokens: np.ndarray) -> bytes:
    """A bit for each class of shingles: whether the set holds an odd number of them.

    Two sets differ in at least as many shingles as these bits differ in places. Fewer classes than
    shingles would leave large sets undecided: any two differ in half of the places at most.
    """
    classes = max(PARITIES, 1 << (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens % np.uint64(classes)).astype(np.int64), minlength=classes) & 1).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Parity bits, as numbers, of the set for fewer classes: class c is c, c + width, ... of the finer ones."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)


def differing(own: np.ndarray, widths: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """In how many places a set's bits differ from those of n sets, given by their width as (places, bits)."""
    out = np.empty(n, dtype=np.int64)
    for width, (at, bits) in widths.items():
        least = min(width, len(own))
        other = bits if least == width else np.bitwise_xor.reduce(bits.reshape(len(at), -1, least), axis=1)
        out[at] = np.bitwise_count(other ^ folded(own, least)).sum(axis=1, dtype=np.int64)
    return out


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of n with any set it links with."""
    return -(-PERCENT * n // 100)


def links(overlap, n, m):
    """Whether sets of n and m shingles with that overlap link, in whole numbers."""
    return 100 * overlap >= PERCENT * (n + m - overlap)


def _hash_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    done: set[int] = set()  # sets that this task has written
    for pdf in batches:
        out = []
        for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
            tokens = shingle_set(text)
            raw = packed(tokens)
            key = xxh3_64_intdigest(raw)
            fresh = len(tokens) > 0 and key not in done
            if fresh:
                if len(done) > 200_000:
                    done.clear()
                done.add(key)
            least = [int(mixed(tokens ^ _SALTS[i]).min().astype(np.int64)) for i in range(ORDERS)] if fresh else None
            out.append((doc_id, key - (key >> 63 << 64), len(tokens), raw if fresh else None, parities(tokens) if fresh else None, least))
        frame = pd.DataFrame(out, columns=["doc_id", "id", "n", "tokens", "bits", "least"])
        yield frame.astype({"doc_id": "Int64", "id": "int64", "n": "int32"})


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def counted(parts: list[np.ndarray]) -> pd.DataFrame:
        token, count = np.unique(np.concatenate(parts), return_counts=True)
        keep = count >= 2
        return pd.DataFrame({"token": token[keep].view(np.int64), "count": count[keep].astype(np.int64)})

    parts, held = [], 0
    for pdf in batches:
        for raw in pdf["tokens"]:
            parts.append(unpacked(raw))
            held += len(parts[-1])
            if held >= COUNTED:
                yield counted(parts)
                parts, held = [], 0
    if parts:
        yield counted(parts)


def _prefixes(token: np.ndarray, count: np.ndarray):
    """Task that lists each set's first shingles, rare ones first.

    The salt is 0 for a shingle that may be in one set only, and 1 to SALTS by the set's id for
    one known to be frequent, so that its rows are dealt to several tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            firsts, sizes, places, known = [], [], [], []
            for raw in pdf["tokens"]:
                own = unpacked(raw)
                n = len(own)
                keep = n - needed(n) + 1
                often = np.zeros(n, dtype=np.int32)
                if len(token):
                    at = np.minimum(np.searchsorted(token, own), len(token) - 1)
                    often = np.where(token[at] == own, count[at], 0)
                first = np.argsort(often, kind="stable")[:keep]
                firsts.append(own[first])
                known.append(often[first] > 0)
                sizes.append(n)
                places.append(n - np.arange(keep, dtype=np.int32))
            if not firsts:
                continue
            held = [len(f) for f in firsts]
            ids = np.repeat(pdf["id"].to_numpy(), held)
            salt = (mixed(ids.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32) + 1
            yield pd.DataFrame({
                "token": np.concatenate(firsts).view(np.int64), "id": ids, "n": np.repeat(np.array(sizes, dtype=np.int32), held),
                "rest": np.concatenate(places), "salt": np.where(np.concatenate(known), salt, 0),
            })

    return run


def _in_several_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (token, id), without repeats and without shingles of one set only.

    At most one row is held back: that of a shingle whose next row may come in the next batch.
    """
    waits: pd.DataFrame | None = None
    last: tuple[int, int] | None = None  # the last row given on
    for pdf in batches:
        rows = pdf if waits is None else pd.concat([waits, pdf], ignore_index=True)
        token, own = rows["token"].to_numpy(), rows["id"].to_numpy()
        if not len(rows):
            continue
        same = token[1:] == token[:-1]
        fresh = np.concatenate(([last != (token[0], own[0])], ~same | (own[1:] != own[:-1])))
        rows = rows[fresh]
        token, own = token[fresh], own[fresh]
        if not len(rows):
            continue
        same = token[1:] == token[:-1]
        shared = (rows["salt"].to_numpy() > 0) | np.concatenate(([last is not None and last[0] == token[0]], same)) | np.concatenate((same, [False]))
        waits, last = (None, (token[-1], own[-1])) if shared[-1] else (rows.iloc[-1:], None)
        yield rows.loc[shared, ["token", "id", "n", "rest"]]


def _local_parts(matrix: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> np.ndarray:
    """A label per member of a block: linked members and members of one group have the same."""
    counts = matrix.astype(np.float32)
    near = links((counts @ counts.T).astype(np.int64), sizes[:, None], sizes[None, :]) | (comps[:, None] == comps[None, :])
    label = np.arange(len(sizes))
    while True:
        low = np.where(near, label[None, :], len(sizes)).min(axis=1)
        if (low == label).all():
            return label
        label = low


def _open_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (block, salt, asks): the members of a block, then its queries."""
    key = members = union = matrix = sizes = comps = parts = last = None
    for pdf in batches:
        found = []
        for grp, block, salt, asks, doc_id, comp, raw in pdf.itertuples(index=False, name=None):
            if (grp, block, salt) != key:
                key, members, union, last = (grp, block, salt), [], None, None
            if (asks, doc_id) == last:
                continue  # another task's copy of the set
            last = (asks, doc_id)
            own = unpacked(raw)
            if not asks:
                members.append((doc_id, comp, own))
                continue
            if union is None:
                sizes = np.array([len(x) for _, _, x in members], dtype=np.int64)
                comps = np.array([c for _, c, _ in members], dtype=np.int64)
                union = np.unique(np.concatenate([x for _, _, x in members]))
                matrix = np.zeros((len(members), len(union)), dtype=bool)
                for i, (_, _, x) in enumerate(members):
                    matrix[i, np.searchsorted(union, x)] = True
                parts = None
            at = np.minimum(np.searchsorted(union, own), len(union) - 1)
            at = at[union[at] == own]
            n = len(own)
            fits = (100 * np.minimum(sizes, n) >= PERCENT * np.maximum(sizes, n)) & (comps != comp)
            if not fits.any() or 180 * len(at) < PERCENT * (n + int(sizes[fits].min())):
                continue  # the union itself overlaps too little: no member can link
            linked = np.flatnonzero(fits & links(matrix[:, at].sum(axis=1), n, sizes))
            if len(linked):
                if not any(doc_id == x for x, _, _ in members):
                    if parts is None:
                        parts = _local_parts(matrix, sizes, comps)
                    linked = linked[np.unique(parts[linked], return_index=True)[1]]  # one link to each connected part
                found += [(doc_id, members[i][0]) for i in linked]  # a member of the block gives all its links there
        if found:
            yield pd.DataFrame(found, columns=["src", "dst"])


def _bound_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Queries that may link with a member of their block, by the members' parity bits."""
    key = members = sizes = comps = bits = None
    for pdf in batches:
        left = []
        for grp, block, salt, asks, doc_id, comp, n, raw in pdf.itertuples(index=False, name=None):
            if (grp, block, salt) != key:
                key, members, bits = (grp, block, salt), [], None
            if not asks:
                members.append((comp, n, raw))
                continue
            if bits is None:
                comps = np.array([c for c, _, _ in members], dtype=np.int64)
                sizes = np.array([m for _, m, _ in members], dtype=np.int64)
                long = np.array([len(r) // 8 for _, _, r in members])
                bits = {}
                for width in np.unique(long).tolist():
                    at = np.flatnonzero(long == width)
                    bits[width] = at, np.frombuffer(b"".join(members[i][2] for i in at), dtype=np.uint64).reshape(len(at), -1)
            differ = differing(np.frombuffer(raw, dtype=np.uint64), bits, len(members))
            most = np.minimum((n + sizes - differ) // 2, np.minimum(n, sizes))
            if ((comps != comp) & links(most, n, sizes)).any():
                left.append((doc_id, comp, grp, block))
        if left:
            yield pd.DataFrame(left, columns=["id", "comp", "grp", "block"])


def _laid_out(asks: DataFrame, blocks: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Members of each block, then the queries to it, each with columns of its set.

    A block with many queries is dealt to several tasks, each with the block's members.
    """
    wanted = asks.groupBy("grp", "block").count().select("grp", "block", F.ceil(F.col("count") / QUERIES_PER_TASK_BLOCK).cast("int").alias("salts"))
    members = blocks.join(wanted, ["grp", "block"]).select("grp", "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("asks"), "id", "comp")
    queries = asks.join(wanted, ["grp", "block"]).select("grp", "block", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.lit(True).alias("asks"), "id", "comp")
    rows = members.union(queries).join(sets.select("id", *columns), "id").select("grp", "block", "salt", "asks", "id", "comp", *columns)
    return rows.repartition("grp", "block", "salt").sortWithinPartitions("grp", "block", "salt", "asks", "id")


def _opened(asks: DataFrame, blocks: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (src, dst): asks (id, comp, grp, block) against blocks (id, comp, grp, block).

    First the short parity bits meet and rule out most queries; whole sets move for the others.
    """
    left = _laid_out(asks, blocks, sets, ["n", "bits"]).mapInPandas(_bound_blocks, "id long, comp long, grp long, block int")
    left = scratch.store(left.distinct())
    release(scratch.spark)
    return _laid_out(left, blocks, sets, ["tokens"]).mapInPandas(_open_blocks, "src long, dst long")


def _leader_links(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of each class with a few classes that have the same minimum in some order."""
    minima = sets.select("id", F.posexplode("least").alias("hash_order", "value"))
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(j)).alias("draw"), "id"))["id"].alias(f"l{j}") for j in range(LEADERS)]
    leaders = (
        minima.groupBy("hash_order", "value").agg(F.count("*").alias("size"), *drawn).where("size > 1")
        .select("hash_order", "value", F.array_distinct(F.array(*[f"l{j}" for j in range(LEADERS)])).alias("leaders"))
    )
    asks = (
        minima.join(leaders, ["hash_order", "value"])
        .select("id", F.col("id").alias("comp"), F.explode("leaders").alias("grp"), F.lit(0).alias("block"))
        .where("id <> grp").groupBy("id", "comp", "grp", "block").count()
        .where(F.col("count") >= AGREEING).drop("count")
    )
    blocks = asks.select(F.col("grp").alias("id"), F.col("grp").alias("comp"), "grp", "block").distinct()
    return _opened(asks, blocks, sets, scratch)


def _membership(ids: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, comp, grp, block, size): each class in a group of similar classes, in bounded blocks.

    Linked classes are grouped by component; the others by the most shared of their minima.
    """
    minima = sets.select("id", F.posexplode("least").alias("hash_order", "value"))
    shared = minima.groupBy("hash_order", "value").agg(F.count("*").alias("held")).where("held > 1")
    pack = (
        minima.join(shared, ["hash_order", "value"]).groupBy("id")
        .agg(F.max(F.struct("held", F.xxhash64("hash_order", "value").alias("grp")))["grp"].alias("pack"))
    )
    placed = (
        ids.join(labels, "id", "left").join(pack, "id", "left")
        .select("id", F.coalesce("component_id", "id").alias("comp"), F.coalesce("component_id", "pack", "id").alias("grp"))
    )
    sizes = placed.groupBy("grp").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") * 2 / BLOCK).cast("int")
    block = F.when(F.col("size") <= BLOCK, 0).otherwise(F.pmod(F.xxhash64("id"), blocks).cast("int"))
    return placed.join(sizes, "grp").select("id", "comp", "grp", block.alias("block"), "size")


def _matrix_candidates(sets: DataFrame, member: DataFrame, often: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp, grp, block): queries and the blocks that may hold a link to another component."""
    token, count = _frequent_arrays(often)
    firsts = sets.select("id", "tokens").mapInPandas(_prefixes(token, count), "token long, id long, n int, rest int, salt int")
    firsts = firsts.repartition("token", "salt").sortWithinPartitions("token", "id")
    rows = scratch.store(firsts.mapInPandas(_in_several_sets, "token long, id long, n int, rest int").join(member, "id"))
    release(scratch.spark)
    matrix = rows.groupBy("token", "grp", "block", "size").agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("rest").alias("rest"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    q, g = rows.alias("q"), matrix.alias("g")
    # Of two blocks that of the smaller group asks; a block of several components asks itself too.
    turn = F.expr("(q.size, q.grp, q.block) <= (g.size, g.grp, g.block) AND (g.low <> q.comp OR g.high <> q.comp)")
    # Of two similar sets the first shared shingle leaves enough shingles from it on, on both sides.
    fits = F.expr(f"100 * q.n >= {PERCENT} * g.least_n AND 100 * g.most_n >= {PERCENT} * q.n") & F.expr(
        f"{100 + PERCENT} * least(q.rest, g.rest) >= {PERCENT} * (q.n + greatest(g.least_n, ceil({PERCENT} * q.n / 100)))"
    )
    return q.join(g, (F.col("q.token") == F.col("g.token")) & turn & fits).select("q.id", "q.comp", "g.grp", "g.block").distinct()


def _frequent_arrays(often: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT shingles and their counts, sorted by shingle: the bound is in the threshold."""
    found = often.toPandas()
    token = found["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.minimum(found["total"].to_numpy(), 2**31 - 1).astype(np.int32)[order]


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    ``docs`` needs doc_id (long) and text; other columns are ignored. A null or blank text has
    an empty set and links with nothing. Repeated rows each keep a row; rows with equal doc_id
    and different texts link like any others. A row with a null doc_id keeps its row, may link
    others, and its component is null unless a document with an id belongs to it. An empty
    table gives an empty result. A set is known by a 64-bit digest.
    """
    scratch = Scratch(docs.sparkSession)
    hashed = scratch.buckets(
        docs.select("doc_id", "text").mapInPandas(_hash_sets, "doc_id long, id long, n int, tokens binary, bits binary, least array<long>"), "id"
    )
    sets = hashed.where("tokens IS NOT NULL").select("id", "n", "tokens", "bits", "least")
    stars = scratch.store(_leader_links(sets, scratch))
    ids = hashed.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("rep"))
    member = scratch.store(_membership(ids.select("id"), components(stars, scratch), sets))
    release(scratch.spark)
    total = hashed.where("tokens IS NOT NULL").agg(F.sum("n")).first()[0] or 0
    often = (
        sets.select("tokens").mapInPandas(_frequent, "token long, count long")
        .groupBy("token").agg(F.sum("count").alias("total"))
        .where(F.col("total") >= max(LEAST_FREQUENT, total / FREQUENT))
    )
    asks = scratch.store(_matrix_candidates(sets, member, often, scratch))
    release(scratch.spark)
    blocks = member.join(asks.select("grp", "block").distinct(), ["grp", "block"]).select("id", "comp", "grp", "block")
    edges = scratch.store(_opened(asks, blocks, sets, scratch).union(stars).distinct())
    found = components(edges, scratch)
    reps = ids.join(found, "id", "left").select("id", "rep", F.coalesce("component_id", "id").alias("root"))
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = reps.join(least, "root").select("id", "component_id")
    out = (
        hashed.select("doc_id", "id", "n")
        .join(labels, "id", "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
    out = scratch.store(out)
    scratch.drop(hashed, stars, member, asks, edges)
    return out
