"""Suffix-array dedup over bytes: sampled suffixes, range partitions by sampled splitters, local sorts.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller
doc_id.  A full suffix array would ship every byte many times, so suffixes are taken where the
hash of ``head`` bytes is the rightmost least one among the places of some string: equal strings
choose the same place, and a suffix stands for all strings that choose it (about 14 of them).

1. blocks send the distinct hashes of their suffixes' heads to hash buckets, which reply which
   heads occur in several documents; all other strings can't repeat;
2. the rest travel as the bytes that their strings cover, each distinct one of a block once with
   its smallest doc_id, to buckets that sampled splitters cut out of the order of heads.  A bucket
   sorts its strings by multikey quicksort (eight bytes at a time, only ties go on) and finds
   equal ones next to each other.  A head that fills more than one bucket (runs of blanks, rules of
   tables) is split below itself: its strings travel one by one, dealt by all their bytes.  So equal
   strings always lie in one bucket, and comparing the last string of a bucket with the first of the
   next can't find a match: they differ within the head or, in a split head, within the string;
3. blocks learn for each string sent whether a smaller doc_id holds it, and cut the bytes.

A passage in a third of all documents is one record for each block.

Cases: null and empty texts have no bytes; texts under ``length`` bytes lose nothing; rows with
the same doc_id are one document and don't cut each other; null doc_ids come after all others and
are one document; cuts may split a character, so the kept bytes are binary; very long texts are
one block; an empty table gives no rows; other columns stay, columns named like the added ones
are replaced.
"""

from __future__ import annotations

import itertools
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condense.llm import blocks as B
from condense.llm.textkit import _BASE, _INVERSE, _TABLE, GROUP, U64, covered, mix, owners, powers
from condense.shipping import ship

HEADS, BITS = 1, 2
#: Blocks whose heads are sampled for splitters, and heads taken of each.
SAMPLE, EACH = 256, 512


class Suffixes:
    """The chosen suffixes of a block: place, and the first and last start of the strings that choose it."""

    def __init__(self, block: B.Block, length: int, head: int):
        self.block, self.length, self.head = block, length, head
        n, offsets, span = block.buf.size, block.offsets, length - head + 1
        sizes = np.diff(offsets)
        ends = np.repeat(offsets[1:], sizes)
        place, first, last, hashes = [], [], [], []
        for low in range(0, max(0, n - length + 1), GROUP):
            high = min(n, low + GROUP + length - 1)
            raw = block.buf[low:high]
            sums = np.empty(raw.size + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_TABLE[raw] * powers(raw.size, _BASE), out=sums[1:])
            g = mix((sums[head:] - sums[:-head]) * powers(raw.size + 1, _INVERSE)[: raw.size - head + 1])
            least = (g & ~U64(0xFFFFFF)) | (U64(0xFFFFFF) - np.arange(g.size, dtype=np.uint64))
            reach = 1
            while reach * 2 <= span:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            if reach < span:
                least = np.minimum(least[: least.size - (span - reach)], least[span - reach :])
            at = (U64(0xFFFFFF) - (least & U64(0xFFFFFF))).astype(np.int64)
            starts = np.arange(low, low + at.size)
            fit = starts + length <= ends[low : low + at.size]
            at, starts = at[fit], starts[fit]
            if not starts.size:
                continue
            fresh = np.ones(starts.size, bool)
            fresh[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
            begin = np.flatnonzero(fresh)
            place.append(at[begin] + low)
            first.append(starts[begin])
            last.append(starts[np.append(begin[1:], starts.size) - 1])
            hashes.append(g[at[begin]])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.place, self.first, self.last = (join(x, np.int64) for x in (place, first, last))
        self.ids = block.ids[owners(offsets)[self.place]] if self.place.size else np.zeros(0, np.int64)
        self.values, self.back = np.unique(B.filter_hashes(join(hashes, np.uint64)), return_inverse=True)

    def holders(self) -> np.ndarray:
        """In how many documents of the block each head is, at most 2."""
        order = np.lexsort((self.ids, self.back))
        ids, back = self.ids[order], self.back[order]
        fresh = np.ones(ids.size, bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (back[1:] != back[:-1])
        return np.minimum(np.bincount(back[fresh], minlength=self.values.size), 2).astype(np.uint8)

    def records(self, often: np.ndarray | None, splitters: np.ndarray, hot: dict[bytes, int]):
        """Distinct bytes of repeated suffixes with their smallest doc_id, by bucket; and for each (record, first start, strings, id)."""
        live = np.flatnonzero(often[self.back] >= 2) if often is not None else np.zeros(0, np.int64)
        data, length = self.block.buf.tobytes() if live.size else b"", self.length
        if not live.size:
            return [], live, live, live
        heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.block.buf, self.head)[self.place[live]]).view(f"S{self.head}").ravel()
        bucket = np.searchsorted(splitters, heads, "right")
        first, last, ids = self.first[live], self.last[live], self.ids[live]
        if hot:
            # one record for each string of a hot head: equal strings still meet, and no head fills a bucket
            spread = np.zeros(heads.size, np.int64)
            for h, k in hot.items():
                spread[heads == h] = k
            n = np.where(spread > 0, last - first + 1, 1)
            at = np.repeat(np.arange(n.size), n)
            single = spread[at] > 0
            begin = first[at] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first, last, ids = np.where(single, begin, first[at]), np.where(single, begin, last[at]), ids[at]
            bucket = bucket[at]
            for k in np.flatnonzero(single).tolist():
                bucket[k] += (crc32(data[first[k] : first[k] + length]) % int(spread[at[k]])) << 20
        seen: dict[bytes, int] = {}
        rows: list[list] = []
        of = np.empty(first.size, np.int64)
        for low in range(0, first.size, 1 << 16):
            part = (x[low : low + (1 << 16)].tolist() for x in (first, last, ids, bucket))
            for k, (a, z, i, b) in enumerate(zip(*part, strict=True), low):
                content = data[a : z + length]
                r = seen.setdefault(content, len(rows))
                if r == len(rows):
                    rows.append([b, content, i])
                elif i < rows[r][2]:
                    rows[r][2] = i
                of[k] = r
        return rows, first, ids, of


RECORD_SCHEMA = "bucket long, block long, content binary, sizes binary, ids binary"


def _send(name: int, rows: list[list]) -> pa.Table:
    order = sorted(range(len(rows)), key=lambda r: rows[r][0])
    out = []
    for b, group in itertools.groupby(order, key=lambda r: rows[r][0]):
        members = list(group)
        out.append((b, name, B.squeeze(b"".join(rows[r][1] for r in members)), B.pack_array(np.array([len(rows[r][1]) for r in members], np.int32)), B.pack_array(np.array([rows[r][2] for r in members], np.int64))))
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "block", "content", "sizes", "ids"])


def multikey_groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of groups) of the equal rows of a byte matrix that are at least two; others are left out."""
    n, width = rows.shape
    order, group = np.arange(n), np.zeros(n, np.int64)
    for at in range(0, width, 8):
        piece = rows[order, at : at + 8]
        if piece.shape[1] < 8:
            piece = np.pad(piece, ((0, 0), (0, 8 - piece.shape[1])))
        key = np.ascontiguousarray(piece).view(">u8").ravel().astype(np.uint64)
        rank = np.lexsort((key, group))
        key, group, order = key[rank], group[rank], order[rank]
        fresh = np.ones(key.size, bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(fresh) - 1
        tied = np.bincount(group, minlength=1)[group] > 1
        order, group = order[tied], group[tied]
        if not order.size:
            break
    fresh = np.ones(order.size, bool)
    fresh[1:] = group[1:] != group[:-1]
    return order, np.flatnonzero(fresh)


def least_by_string(data: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each string of length bytes of the records in data: the smallest id of any record that holds it.

    Rolling hashes tell which strings can have an equal at all; these are sorted by their bytes.
    """
    strings = size - length + 1
    begin = np.repeat(np.cumsum(size) - size - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())
    holder = np.repeat(ids, strings)
    h = np.empty(begin.size, np.uint64)
    for low in range(0, begin.size, GROUP):
        at = begin[low : low + GROUP]
        part = data[at[0] : at[-1] + length]
        sums = np.zeros(part.size + 1, np.uint64)
        np.cumsum(_TABLE[part] * powers(part.size, _BASE), out=sums[1:])
        at = at - at[0]
        h[low : low + GROUP] = (sums[at + length] - sums[at]) * powers(part.size + 1, _INVERSE)[at]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(h.size, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    some = np.flatnonzero(again)
    order, starts = multikey_groups(np.lib.stride_tricks.sliding_window_view(data, length)[begin[some]])
    if order.size:
        holder[some[order]] = np.repeat(np.minimum.reduceat(holder[some[order]], starts), np.diff(np.append(starts, order.size)))
    return holder


def suffix_dedup(docs: DataFrame, length: int = 50, head: int = 24, seed: int = 5) -> DataFrame:
    """All columns of docs, and kept (binary), n_bytes, n_removed, n_spans."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    blocks = B.block_table(docs)
    buckets = B.n_buckets(blocks)
    # splitters from at most SAMPLE blocks, EACH suffixes of each
    share = max(1, blocks.count() // SAMPLE)

    def heads_of(block):
        found, rng = Suffixes(block, length, head), np.random.Generator(np.random.PCG64([seed, block.name]))
        some = rng.permutation(found.place)[:EACH]
        yield pa.RecordBatch.from_arrays([pa.array([block.buf[p : p + head].tobytes() for p in some.tolist()], pa.binary())], ["head"])

    sampled = sorted(r[0] for r in B.each_block(blocks.where(F.pmod(F.xxhash64("block", F.lit(seed)), F.lit(share)) == 0), heads_of, "head binary").toLocalIterator())
    quantiles = [bytes(sampled[len(sampled) * i // buckets]) for i in range(1, buckets)] if sampled else []
    splitters = np.array(sorted(set(quantiles)), dtype=f"S{head}")
    # a head that several quantiles fall on fills more than a bucket: its strings go one by one, dealt by their bytes
    hot = {h: n for h, n in Counter(quantiles).items() if n > 1}

    def send_heads(block):
        found = Suffixes(block, length, head)
        if found.values.size:
            yield B.bucket_rows(block.name, found.values, found.holders(), buckets)

    often = B.materialized(B.tally(B.each_block(blocks, send_heads, B.BUCKET_SCHEMA), cap=2, kind=HEADS))

    def send_records(block, table):
        rows, _, _, _ = Suffixes(block, length, head).records(B.replies(table, HEADS), splitters, hot)
        return _send(block.name, rows)

    def sort_bucket(key, table):
        B.trim()
        sizes = [B.unpack_array(x.as_py()) for x in table["sizes"]]
        raw = b"".join(B.expand(x.as_py()) for x in table["content"])
        size, ids = np.concatenate(sizes).astype(np.int64), np.concatenate([B.unpack_array(x.as_py()) for x in table["ids"]])
        ends = np.cumsum(size)
        # blocks often send the same bytes: sort each once, with the smallest doc_id
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(raw[a:z], len(seen)) for a, z in zip((ends - size).tolist(), ends.tolist(), strict=True)], np.int64)
        least = np.full(len(seen), B.NO_ID)
        np.minimum.at(least, of, ids)
        own = np.fromiter(map(len, seen), np.int64, len(seen))
        first = least_by_string(np.frombuffer(b"".join(seen), np.uint8), own, least, length)
        n, strings = size - length + 1, own - length + 1
        place = np.repeat((np.cumsum(strings) - strings)[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        late = (first[place] < np.repeat(ids, n)).astype(np.uint8)
        cut = np.cumsum([int(s.sum()) - (length - 1) * s.size for s in sizes])[:-1]
        n = table.num_rows
        return pa.table({"block": table["block"], "kind": pa.array([BITS] * n, pa.int32()), "bucket": pa.array([key[0].as_py()] * n, pa.int64()), "reply": pa.array([B.pack_array(x) for x in np.split(late, cut)], pa.binary())})

    sent = B.with_replies(blocks, often, send_records, RECORD_SCHEMA)
    late = B.materialized(sent.groupBy("bucket").applyInArrow(sort_bucket, B.REPLY_SCHEMA))

    def cut(block, table):
        gone = np.zeros(block.buf.size, bool)
        bits = B.replies(table, BITS)
        if bits is not None:
            found = Suffixes(block, length, head)
            rows, first, ids, of = found.records(B.replies(table, HEADS), splitters, hot)
            strings = np.array([len(r[1]) - length + 1 for r in rows])
            order = np.array(sorted(range(len(rows)), key=lambda r: rows[r][0]))
            begin = np.empty(len(rows), np.int64)
            begin[order] = np.cumsum(strings[order]) - strings[order]
            own = ids == np.array([r[2] for r in rows], np.int64)[of]
            n = strings[of]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out = ~np.repeat(own, n) | (bits[np.repeat(begin[of], n) + offset] > 0)
            gone = covered(gone.size, np.sort((np.repeat(first, n) + offset)[out]), length)
        keep = ~gone
        kept_at = np.concatenate([[0], np.cumsum(keep)])[block.offsets]
        kept = block.buf[keep].tobytes()
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inner = block.offsets[1:-1]
        inner = inner[inner < gone.size]
        begin[inner] = gone[inner]
        spans = np.diff(np.concatenate([[0], np.cumsum(begin)])[block.offsets])
        n_bytes = np.diff(block.offsets)
        table = block.table.append_column("kept", pa.array([kept[a:z] for a, z in itertools.pairwise(kept_at.tolist())], pa.binary()))
        return table.append_column("n_bytes", pa.array(n_bytes)).append_column("n_removed", pa.array(n_bytes - np.diff(kept_at))).append_column("n_spans", pa.array(spans))

    schema = T.StructType([*docs.schema.fields, T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])
    return B.with_replies(blocks, often.unionByName(late), cut, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
