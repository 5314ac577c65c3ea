"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

A document's set holds the hashes of its distinct shingles.  Two sets that reach the similarity
share a token among the first n - ceil(t n) + 1 of each under *any* global order, so candidates
must share one under each of several orders.  All put tokens held by one document first.  The first
order then goes from rare to frequent (how many documents hold a token, counted over the corpus up
to 65,535), the others are two random ones that know nothing of frequency.

1. rows with equal sets form a class (128-bit set hash), numbered by its first row;
2. blocks send their distinct tokens to hash buckets, which reply how many documents hold each.
   Tokens held once are in no intersection: a set with too few others links with nothing and
   leaves here, and the rest keep only shared tokens;
3. stars: in each group of one prefix token of the first order the member whose tokens are held most
   often (the middle of a group of near copies) is the pivot, the others are candidates with it, and
   the links found are contracted to components.  This takes a pair for each member, where a group
   of near copies has a square of them;
4. what may still link lies between components: members of one token's group in different
   components, near enough by what follows their first common token;
5. the candidates of 3 and 4 meet the prefixes of the other orders first (32 bits of each token, joined
   as arrays) and only pairs that share one in each go on to verification, where sets travel.
   None is capped or sampled.  Components over the links give every document its smallest doc_id;
6. links: inside each component all classes are compared, as counts of shared tokens from products
   of 0/1 matrices.  A component of over ``TILE`` classes or ``TOKENS`` tokens is cut into parts of that size,
   and each pair of parts is a group of its own; pairs are counted and never written down.

Verification counts shared tokens (48 bits of hash) of squeezed sets that meet by join; a pivot
with many partners is split into chunks of about ``CHUNK``, its set copied to each.

Cases: null and empty texts and texts without words have the empty set and link with nothing; a
text of fewer words than a shingle is one shingle of its own length; repeated rows are one class;
rows are told apart by their places, so equal or null doc_ids don't tie different texts together; a
null doc_id comes after all others, and a component of such rows alone has none; very long texts are
one set; an empty table gives no rows; extra columns are ignored (``distinct_documents`` keeps them).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condense.llm import blocks as B
from condense.llm.graph import components
from condense.llm.textkit import SPACED, U64, owners, seeded, span_hashes, spans, windows, windows_at
from condense.shipping import ship

COUNTS, LEADERS, KEEP = 1, 2, 3
ORDERS = 3
CHUNK, TILE, TOKENS = 256, 1024, 1 << 20
#: Columns of the 0/1 matrices that are multiplied at once.
SLAB = 8192
#: Documents that hold a token are counted up to this.
MOST = 65_535
_LOW = U64(16)


class Sets:
    """The distinct shingles of each document of a block, in the order of documents and hashes."""

    def __init__(self, block: B.Block, k: int):
        self.block = block
        starts, ends, bounds = spans(block.buf, block.offsets, SPACED)
        h = span_hashes(block.buf, starts, ends, fold=True)
        n, docs = np.diff(bounds), owners(bounds)
        whole = np.flatnonzero(docs[k - 1 :] == docs[: max(0, h.size - k + 1)]) if h.size >= k else np.zeros(0, np.int64)
        tokens, at = [windows(h, k)[whole]], [docs[whole]]
        for short in range(1, k):
            few = np.flatnonzero(n == short)
            tokens.append(seeded(windows_at(h, bounds[:-1][few], short), short))
            at.append(few)
        tokens, at = np.concatenate(tokens), np.concatenate(at)
        tokens = (tokens >> _LOW) << _LOW
        order = np.argsort(tokens, kind="stable")
        order = order[np.argsort(at[order].astype(np.int32), kind="stable")]
        tokens, at = tokens[order], at[order]
        fresh = np.ones(tokens.size, bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (at[1:] != at[:-1])
        self.tokens, self.docs = tokens[fresh], at[fresh]
        self.n = np.bincount(self.docs, minlength=block.rows)
        self.bounds = np.concatenate([[0], np.cumsum(self.n)])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two sums over each set that stand for it."""
        total = lambda seed: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(seeded(self.tokens, seed))])[self.bounds]).view(np.int64)
        return total(21), total(22)


def prefixes(tokens: np.ndarray, held: np.ndarray, n: int, size: int) -> list[np.ndarray]:
    """The prefix of a set under each order; tokens held once come first and are left out already."""
    length = max(0, size - (n - tokens.size))
    rare = tokens[np.lexsort((seeded(tokens, 31), held))[:length]]
    return [rare, *(tokens[np.argsort(seeded(tokens, 31 + o), kind="stable")[:length]] for o in range(1, ORDERS))]


def _bound(a: str, b: str, num: int, den: int) -> Column:
    """Whether two sets can reach the similarity if this is their first common token in the order.

    What follows the token in either set is all they can share besides it.  A later common token only
    gives a smaller bound, so a pair passes by some token just when it passes by its first.
    """
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return den * most >= num * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def _verified(pairs: DataFrame, sets: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """The links among pairs (a, b): first by the prefixes of the other orders, then by the sets."""
    pairs = B.materialized(pairs)
    many = B.materialized(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    split = pairs.join(many, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    chunks = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    others = [f"p{o}" for o in range(1, ORDERS)]
    mine = signs.join(many, signs["id"] == many["a"]).select("a", chunks, *others)
    theirs = split.join(signs, split["b"] == signs["id"]).select("a", "chunk", "b", *(F.col(p).alias(f"b{p}") for p in others))
    both = theirs.join(mine, ["a", "chunk"])
    for p in others:
        both = both.where(F.arrays_overlap(p, f"b{p}"))
    passed = B.materialized(both.select("a", "chunk", "b"))
    left = sets.join(many, sets["id"] == many["a"]).select("a", chunks, "n", "tokens")
    right = passed.join(sets, passed["b"] == sets["id"]).select("a", "chunk", "b", "n", "tokens").toDF("a", "chunk", "b", "bn", "btokens")

    def verify(key, ones, others):
        B.trim()
        found = []
        for n, tokens in zip(ones["n"].to_pylist(), ones["tokens"].to_pylist(), strict=True):
            mine = B.unpack_sorted(tokens)
            for b, bn, btokens in zip(*(others[c].to_pylist() for c in ("b", "bn", "btokens")), strict=True):
                shared = np.intersect1d(mine, B.unpack_sorted(btokens), assume_unique=True).size
                if den * shared >= num * (n + bn - shared):
                    found.append(b)
        return pa.table({"a": pa.array([key[0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return B.materialized(left.groupBy("a", "chunk").cogroup(right.groupBy("a", "chunk")).applyInArrow(verify, "a long, b long"))


def _shared(ones: list[np.ndarray], others: list[np.ndarray] | None) -> np.ndarray:
    """How many tokens each of ones has in common with each of others (with each other if None)."""
    every = ones if others is None else ones + others
    _, number = np.unique(np.concatenate(every), return_inverse=True)
    owner = np.repeat(np.arange(len(every)), [x.size for x in every])
    often = np.bincount(number) > 1
    columns, number = int(often.sum()), np.where(often, np.cumsum(often) - 1, -1)[number]
    owner, number = owner[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    out = np.zeros((len(ones), len(every) - (0 if others is None else len(ones))), np.float32)
    for low in range(0, columns, SLAB):
        i, j = np.searchsorted(number, [low, low + SLAB])
        matrix = np.zeros((len(every), min(SLAB, columns - low)), np.float32)
        matrix[owner[i:j], number[i:j] - low] = 1
        out += matrix[: len(ones)] @ (matrix if others is None else matrix[len(ones) :]).T
    return out


def _linked(sets: DataFrame, sizes: DataFrame, part: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(id, links) of classes in components: how many documents of other classes each links with."""
    members = part.join(sizes, "node").join(sets, F.col("node") == F.col("id")).select("id", "label", "size", "n", "tokens")
    most = F.greatest(F.count("*") / TILE, F.sum("n") / TOKENS)
    counts = B.materialized(part.join(sets.select("id", "n"), F.col("node") == F.col("id")).groupBy("label").agg(F.ceil(most).cast("int").alias("parts")))
    # small components share a group, large ones are cut into parts
    group = F.when(F.col("parts") > 1, F.col("label")).otherwise(-1 - F.pmod(F.xxhash64("label"), F.lit(buckets)))
    placed = members.join(counts, "label").select(group.alias("g"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("t"), "parts", "id", "label", "size", "n", "tokens")
    packed_schema = "g long, t int, parts int, rows binary"

    def pack(key, table):
        sink = pa.BufferOutputStream()
        slim = table.select(["id", "label", "size", "n", "tokens"]).combine_chunks()
        with pa.ipc.new_stream(sink, slim.schema) as out:
            out.write_table(slim)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "t": pa.array([key[1].as_py()], pa.int32()), "parts": table["parts"].slice(0, 1).cast(pa.int32()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    packs = B.materialized(placed.groupBy("g", "t").applyInArrow(pack, packed_schema))
    met = packs.select("g", "t", "rows", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("u")).select("g", F.least("t", "u").alias("low"), F.greatest("t", "u").alias("high"), "t", "rows")

    def linked(shared, n, m):
        return den * shared.astype(np.int64) >= num * (n[:, None] + m[None, :] - shared.astype(np.int64))

    def count(key, table):
        B.trim()
        found = [pa.ipc.open_stream(r.as_py()).read_all() for _, r in sorted(zip(table["t"].to_pylist(), table["rows"], strict=True), key=lambda x: x[0])]
        ids, links = [], []
        if len(found) == 2:
            (a, x), (b, y) = ((t, [B.unpack_sorted(v.as_py()) for v in t["tokens"]]) for t in found)
            hit = linked(_shared(x, y), a["n"].to_numpy(), b["n"].to_numpy())
            for t, sums in ((a, hit @ b["size"].to_numpy()), (b, a["size"].to_numpy() @ hit)):
                ids.append(t["id"].to_numpy())
                links.append(sums)
        else:
            rows = found[0].take(pa.compute.sort_indices(found[0]["label"]))
            label, size, n, every = rows["label"].to_numpy(), rows["size"].to_numpy(), rows["n"].to_numpy(), rows["id"].to_numpy()
            for low, high in itertools.pairwise([0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), label.size]):
                tokens = [B.unpack_sorted(v.as_py()) for v in rows["tokens"].slice(low, high - low)]
                hit = linked(_shared(tokens, None), n[low:high], n[low:high])
                np.fill_diagonal(hit, False)
                ids.append(every[low:high])
                links.append(hit @ size[low:high])
        return pa.table({"id": pa.array(np.concatenate(ids)), "links": pa.array(np.concatenate(links).astype(np.int64))})

    return met.groupBy("g", "low", "high").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _components(blocks: DataFrame, k: int, num: int, den: int, count_links: bool) -> DataFrame:
    """(key, doc, n, first, component, n_links) for every row of a block table; first is the key of the component's first row."""
    buckets = B.n_buckets(blocks)

    def list_sets(block):
        sets = Sets(block, k)
        a, b = sets.keys()
        yield pa.RecordBatch.from_arrays([pa.array((block.name << B.ROW_BITS) + np.arange(block.rows)), pa.array(block.ids), pa.array(sets.n), pa.array(a), pa.array(b)], ["key", "doc", "n", "x", "y"])

    every = B.materialized(B.each_block(blocks, list_sets, "key long, doc long, n long, x long, y long"))
    first = F.min(F.struct("doc", "key"))
    classes = B.materialized(every.where("n > 0").groupBy("x", "y").agg(F.min("key").alias("id"), first.alias("first"), F.count("*").alias("size")))

    def pack_rows(key, table):
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "kind": pa.array([LEADERS], pa.int32()), "bucket": pa.array([0], pa.int64()), "reply": pa.array([B.pack_array(np.sort(table["row"].to_numpy()))], pa.binary())})

    at = classes.select(F.shiftright("id", B.ROW_BITS).alias("block"), F.col("id").bitwiseAND((1 << B.ROW_BITS) - 1).cast("int").alias("row"))
    leaders = at.groupBy("block").applyInArrow(pack_rows, B.REPLY_SCHEMA)

    def send_tokens(block):
        values, times = np.unique(B.filter_hashes(Sets(block, k).tokens), return_counts=True)
        if values.size:
            yield B.bucket_rows(block.name, values, np.minimum(times, MOST).astype(np.uint16), buckets)

    counts = B.tally(B.each_block(blocks, send_tokens, B.BUCKET_SCHEMA), cap=MOST, kind=COUNTS)

    def shared_sets(block, table):
        rows = B.replies(table, LEADERS)
        out: list[tuple] = []
        if rows is not None:
            sets = Sets(block, k)
            times = B.replies(table, COUNTS)[np.unique(B.filter_hashes(sets.tokens), return_inverse=True)[1]]
            for i in rows.tolist():
                low, high = sets.bounds[i], sets.bounds[i + 1]
                held = times[low:high]
                often = held > 1
                n, m = int(high - low), int(often.sum())
                if m and den * m >= num * n:
                    out.append(((block.name << B.ROW_BITS) + i, n, m, B.pack_sorted(sets.tokens[low:high][often] >> _LOW), B.pack_array(held[often])))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "n", "m", "tokens", "held"])

    sets = B.materialized(B.with_replies(blocks, counts.unionByName(leaders), shared_sets, "id long, n int, m int, tokens binary, held binary"))
    size = lambda n: n - -(-num * n // den) + 1

    def list_prefixes(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for i, n, shared, packed, held in zip(*(batch[c].to_pylist() for c in ("id", "n", "m", "tokens", "held")), strict=True):
                held = B.unpack_array(held)
                p = prefixes(B.unpack_sorted(packed), held, n, size(n))[0]
                found = p, np.full(p.size, i), np.full(p.size, n, np.int32), np.arange(n - shared, n - shared + p.size, dtype=np.int32), np.full(p.size, held.sum() / n)
                for column, values in zip(columns, found, strict=True):
                    column.append(values)
            if columns[0]:
                token, *rest = map(np.concatenate, columns)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *map(pa.array, rest)], ["token", "id", "n", "pos", "centre"])

    prefix = B.materialized(sets.mapInArrow(list_prefixes, "token long, id long, n int, pos int, centre double"))

    def list_signs(batches):
        for batch in batches:
            found = [(i, *(x.astype(np.uint32).view(np.int32) for x in prefixes(B.unpack_sorted(t), B.unpack_array(h), n, size(n))[1:])) for i, n, t, h in zip(*(batch[c].to_pylist() for c in ("id", "n", "tokens", "held")), strict=True)]
            if found:
                ids, *signs = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(s, pa.list_(pa.int32())) for s in signs)], ["id", *(f"p{o}" for o in range(1, ORDERS))])

    signs = sets.mapInArrow(list_signs, "id long, " + ", ".join(f"p{o} array<int>" for o in range(1, ORDERS)))

    pivots = B.materialized(prefix.groupBy("token").agg(F.count("*").alias("c"), F.max_by(F.struct("id", "n", "pos"), F.struct("centre", (-F.col("id")).alias("i"))).alias("p")).where("c > 1").select("token", "p.*"))
    stars = prefix.alias("b").join(pivots.alias("a"), F.col("a.token") == F.col("b.token")).where((F.col("a.id") != F.col("b.id")) & _bound("a", "b", num, den)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    links = _verified(stars, sets, signs, num, den)

    part = components(links)
    placed = B.materialized(prefix.join(part, F.col("id") == F.col("node"), "left").select("token", "id", "n", "pos", F.coalesce("label", "id").alias("part")))
    near = (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.part") != F.col("b.part")) & _bound("a", "b", num, den)
    rest = placed.alias("a").join(placed.alias("b"), near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    more = _verified(rest, sets, signs, num, den)
    if more.limit(1).count():
        part = components(links.unionByName(more))

    named = classes.join(part, F.col("id") == F.col("node"), "left").select("x", "y", "id", "size", "first", F.coalesce("label", "id").alias("label"))
    if count_links:
        linked = _linked(sets, classes.select(F.col("id").alias("node"), "size"), part, buckets, num, den)
        named = named.alias("c").join(linked.alias("l"), F.col("c.id") == F.col("l.id"), "left").select("c.*", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    else:
        named = named.withColumn("n_links", F.lit(None).cast("long"))
    named = B.materialized(named)
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    named = B.materialized(named.join(least, "label").select("x", "y", "least", "n_links"))
    joined = every.join(named, (F.col("n") > 0) & (every["x"] == named["x"]) & (every["y"] == named["y"]), "left")
    return joined.select("key", "doc", "n", F.coalesce("least.key", "key").alias("first"), F.coalesce("least.doc", "doc").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (how many other documents it links with) for every document.

    k: words in a shingle.  Documents link when den * shared >= num * union.
    """
    ship(docs.sparkSession)
    found = _components(B.block_table(docs.select("doc_id", "text")), k, num, den, True)
    real = lambda c: F.when(F.col(c) != B.NO_ID, F.col(c))
    return found.select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), "n_links")


def distinct_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that are the first (by doc_id, then place) of their component, with all their columns."""
    ship(docs.sparkSession)
    blocks = B.block_table(docs)
    gone = _components(blocks, k, num, den, False).where("key <> first")
    gone = gone.select(F.shiftright("key", B.ROW_BITS).alias("block"), F.col("key").bitwiseAND((1 << B.ROW_BITS) - 1).cast("int").alias("row"))

    def pack(key, table):
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "kind": pa.array([KEEP], pa.int32()), "bucket": pa.array([0], pa.int64()), "reply": pa.array([B.pack_array(table["row"].to_numpy())], pa.binary())})

    replies = B.materialized(gone.groupBy("block").applyInArrow(pack, B.REPLY_SCHEMA))

    def keep(block, table):
        stay, out = np.ones(block.rows, bool), B.replies(table, KEEP)
        if out is not None:
            stay[out] = False
        return block.table.filter(pa.array(stay))

    return B.with_replies(blocks, replies, keep, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(x[i:i + 3], ' ')) AS h, array_to_string(x[i:i + 3], ' ') AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(x) - 3, 1) + 1)) AS i) WHERE len(x) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.r = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.r) AS component_id, CAST(coalesce(any_value(k.n_links), 0) AS BIGINT) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents) d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1) k USING (doc_id) GROUP BY 1
"""
