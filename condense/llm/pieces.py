"""SentencePiece encoding and decoding by a relational lattice.

Spaces become the meta symbol and a text gets one in front.  A text is cut wherever no piece holds the
two characters around the place: no piece crosses such a cut, so its units can be encoded one by one,
each distinct one of the corpus once.  For each:

1. its substrings of up to the longest piece's length are exploded, one row each;
2. they are joined with the piece table (one vocabulary file, so broadcast is bounded);
3. the edges found (one number each) are grouped by unit and sorted;
4. a higher-order ``aggregate`` folds them to the places where pieces begin.

The fold follows the kind of model.  Where scores are probabilities it is Viterbi: edges by their
ends, the path with the highest sum (``viterbi``).  Where scores are merge ranks, as in the file at
hand, that path is not what the model means, and the fold takes edges by rank instead (``merges``): an
edge joins if both its ends still stand and just one place between them does.  One pass in the order of ranks
is the model's own encoding if every piece comes out whole from its own characters: should a later join open an earlier
edge, the characters under that edge, which no join has crossed, would have been joined to it at its turn.  The
tests check that for all pieces, and compare ids with the model's own library.

Decoding looks up the bytes of ids; ``round_trip`` tells whether that gives the text.  The meta symbol
as a character of a text is encoded by its bytes, and so is any character that no piece holds.

Blocks send distinct units to hash buckets, packed, and get back masks of cuts for each; the
units of a block's texts then turn to ids by array lookups.  A unit in a third of all texts is one
entry for each block.  Units of any length are folded whole: a mask is as many numbers as it needs.

Cases: null and empty texts have no pieces; null doc_ids and repeated rows are rows like others; an empty
table gives no rows; other columns stay, columns named n_tokens, ids or round_trip are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condense.llm import blocks as B
from condense.llm.textkit import ranges, span_hashes
from condense.shipping import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
MASKS = 1
#: Smaller than other operators' blocks: ids and their places take many times the bytes of a text.
SIZE = 4 << 20
#: Places in one number of a mask.
WORD = 63


class Vocabulary:
    """Pieces as bytes with spaces for meta symbols; ids of single bytes."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = sp.vocab_size()
        self.bytes_of: list[bytes] = []
        self.rows: list[tuple[int, str, float]] = []
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(META, " ")
                self.bytes_of.append(text.encode())
                self.rows.append((i, text, sp.get_score(i)))
        self.longest = max(len(r[1]) for r in self.rows)
        if self.longest >= WORD - 1:
            raise ValueError(f"pieces of {WORD - 1} characters and more don't fit a mask")
        self.merges = all(score == int(score) for _, _, score in self.rows)

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Rising hashes of pieces and their ids."""
        raw = [r[1].encode() for r in self.rows]
        ends = np.cumsum([len(x) for x in raw])
        h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)
        order = np.argsort(h)
        return h[order], np.array([r[0] for r in self.rows], np.int32)[order]

    def joins(self) -> np.ndarray:
        """For the last byte of a character and the first of the next: whether any piece holds such two."""
        out = np.zeros((256, 256), bool)
        for _, text, _ in self.rows:
            for a, b in itertools.pairwise(text):
                out[a.encode()[-1], b.encode()[0]] = True
        return out

    def table(self) -> list[tuple[str, float]]:
        """Pieces and their scores, or for merge ranks the longer pieces and their places in the order of merging."""
        if not self.merges:
            return [(text, score) for _, text, score in self.rows]
        place = {score: i for i, score in enumerate(sorted({-score for _, _, score in self.rows}))}
        return [(text, float(place[-score])) for _, text, score in self.rows if len(text) > 1]

    def data(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all ids in turn, where each id's begin, and how many they are."""
        size = np.array([len(x) for x in self.bytes_of])
        return np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(size) - size, size


class Units:
    """The units of a block's texts: spans in a buffer with a space before each text, and the distinct ones."""

    def __init__(self, block: B.Block, joins: np.ndarray):
        full = np.diff(block.offsets) > 0
        self.buf = np.insert(block.buf, block.offsets[:-1][full], 32)
        self.offsets = block.offsets + np.concatenate([[0], np.cumsum(full)])
        buf = self.buf
        start = np.zeros(buf.size, bool)
        if buf.size:
            start[1:] = ((buf[1:] & 0xC0) != 0x80) & ~joins[buf[:-1], buf[1:]]
            start[self.offsets[:-1][full]] = True
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], buf.size) if self.starts.size else self.starts
        self.bounds = np.searchsorted(self.starts, self.offsets)
        h = span_hashes(buf, self.starts, self.ends)
        self.values, self.first, self.back = np.unique(h, return_index=True, return_inverse=True)

    def gathered(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all distinct units in turn, and their sizes."""
        size = self.ends[self.first] - self.starts[self.first]
        return self.buf[ranges(self.starts[self.first], size)], size


def _unpack(data: bytes, sizes: bytes) -> list[bytes]:
    raw, cut = B.expand(data), np.concatenate([[0], np.cumsum(B.unpack_array(sizes).astype(np.int64))]).tolist()
    return [raw[a:z] for a, z in itertools.pairwise(cut)]


def _shl(a: Column, b: Column) -> Column:
    return F.call_function("shiftleft", a, b.cast("int"))


def _shr(a: Column, b: Column) -> Column:
    return F.call_function("shiftright", a, b.cast("int"))


_FULL = (1 << WORD) - 1


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _full(n: Column) -> Column:
    """Masks with all places 0 .. n."""
    left = lambda i: n + 1 - WORD * i
    return F.transform(F.sequence(F.lit(0), F.floor(n / WORD).cast("int")), lambda i: F.when(left(i) >= WORD, _long(_FULL)).otherwise(_shl(_long(1), left(i)) - 1))


def _step(window: Column, length: Column) -> Column:
    """The place in a window of a mask that a join of its first length characters removes, as a bit, or 0."""
    part = window.bitwiseAND(_shl(_long(1), length + 1) - 1)
    ends = _shl(_long(1), length) + 1
    inner = part - ends
    return F.when((part.bitwiseAND(ends) == ends) & (inner.bitwiseAND(inner - 1) == 0), inner).otherwise(_long(0))


def merges(edges: Column, n: Column) -> Column:
    """Masks of the places where pieces begin and end, from edges (rank, end, length) as numbers in order."""
    length = lambda e: e.bitwiseAND(1023)
    start = lambda e: F.shiftright(e, 10).bitwiseAND(0xFFFFFFFF) - length(e)
    short = F.aggregate(edges, _shl(_long(1), n + 1) - 1, lambda mask, e: mask - _shl(_step(_shr(mask, start(e)), length(e)), start(e)))

    def step(masks: Column, e: Column) -> Column:
        at, shift = F.floor(start(e) / WORD).cast("int"), (start(e) % WORD).cast("int")
        window = _shr(F.get(masks, at), shift).bitwiseOR(_shl(F.coalesce(F.get(masks, at + 1), _long(0)), WORD - shift))
        gone = _step(window, length(e))
        low = lambda v: v - _shl(gone, shift).bitwiseAND(_FULL)
        high = lambda v: v - _shr(gone, WORD - shift)
        return F.when(gone == 0, masks).otherwise(F.transform(masks, lambda v, i: F.when(i == at, low(v)).when(i == at + 1, high(v)).otherwise(v)))

    return F.when(n < WORD - 1, F.array(short)).otherwise(F.aggregate(edges, _full(n), step))


def viterbi(edges: Column, n: Column) -> Column:
    """Masks of the path with the highest sum of scores, of equal ones the one with the longest last piece; edges are structs (end, start, score) in order."""
    state = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(0)).alias("back"))

    def step(a: Column, e: Column) -> Column:
        new, size = F.get(a["best"], e["start"]) + e["score"], F.size(a["best"])
        put = lambda array, value, upto: F.concat(F.slice(array, F.lit(1), upto), F.array(value))
        at = lambda upto: F.struct(put(a["best"], new, upto).alias("best"), put(a["back"], e["start"], upto).alias("back"))
        return F.when(size == e["end"], at(size)).when(new > F.element_at(a["best"], -1), at(size - 1)).otherwise(a)

    def path(back: Column) -> Column:
        first = F.struct(n.alias("at"), F.array(n).alias("places"))
        walk = F.aggregate(back, first, lambda a, _: F.when(a["at"] <= 0, a).otherwise(F.struct(F.get(back, a["at"]).alias("at"), F.concat(a["places"], F.array(F.get(back, a["at"]))).alias("places"))))
        bits = lambda i: F.aggregate(F.filter(walk["places"], lambda p: F.floor(p / WORD) == i), _long(0), lambda m, p: m.bitwiseOR(_shl(_long(1), p % WORD)))
        return F.transform(F.sequence(F.lit(0), F.floor(n / WORD).cast("int")), bits)

    # the array of one path lets it be built once
    return F.aggregate(edges, state, step, lambda a: F.get(F.transform(F.array(a["back"]), path), F.lit(0)))


def segmented(units: DataFrame, table: list[tuple[str, float]], longest: int, by_merges: bool, partitions: int) -> DataFrame:
    """(uid, mask) for rows (uid, unit) with unique uids: steps 1 to 4.

    A unit has some sixty times its size in substrings, so the number of partitions is set by hand.
    """
    known = F.broadcast(units.sparkSession.createDataFrame(table, "piece string, score double"))
    # a unit's rows stay in its partition through both explodes and the broadcast join, so grouping needs no exchange
    units = units.repartition(partitions, "uid").withColumn("n", F.length("unit"))
    ends = units.select("uid", "unit", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("e"))
    # merging needs no edges of one character; one row of each unit stays whatever is found
    least = F.when(F.col("e") == 1, 1).otherwise(2) if by_merges else F.lit(1)
    substrings = ends.select("uid", "unit", "n", "e", F.explode(F.sequence(least, F.greatest(least, F.least(F.col("e"), F.lit(longest))))).alias("l"))
    lattice = substrings.select("uid", "n", "e", "l", F.expr("substring(unit, e - l + 1, l)").alias("part")).join(known, F.col("part") == F.col("piece"), "left").where("score IS NOT NULL OR l = 1")
    if by_merges:
        edge = F.when(F.col("score").isNotNull(), _shl(F.col("score").cast("long"), F.lit(42)) + _shl(F.col("e").cast("long"), F.lit(10)) + F.col("l"))
        fold = merges
    else:
        worst = min((x[1] for x in table), default=0.0) - 10.0  # as of an unknown character
        edge = F.struct("e", (F.col("e") - F.col("l")).alias("start"), F.coalesce("score", F.lit(worst)).alias("score")).cast("struct<end:int,start:int,score:double>")
        fold = viterbi
    edges = lattice.select("uid", "n", edge.alias("edge")).groupBy("uid", "n").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    return edges.select("uid", fold(F.col("edges"), F.col("n")).alias("mask"))


def decoded(ids: np.ndarray, data: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ids in turn, and how many each has."""
    raw, start, size = data
    return raw[ranges(start[ids], size[ids])], size[ids]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of docs, and n_tokens, ids, round_trip (whether the ids decode to the text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_tokens", "ids", "round_trip")
    blocks = B.block_table(docs, SIZE, level=9)
    buckets = B.n_buckets(blocks)
    vocabulary = Vocabulary(model)
    known = spark.sparkContext.broadcast((*vocabulary.lookup(), vocabulary.byte_ids, vocabulary.joins(), vocabulary.data()))

    def send(block):
        units = Units(block, known.value[3])
        raw, size = units.gathered()
        cut, at = B.split_sorted(units.values, buckets).tolist(), np.concatenate([[0], np.cumsum(size)])
        rows = [(b, B.squeeze(raw[at[i] : at[j]].tobytes()), B.pack_array(size[i:j].astype(np.uint8 if not size.size or size.max() < 256 else np.int32))) for b, (i, j) in enumerate(itertools.pairwise(cut)) if j > i]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([block.name] * len(rows), pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["bucket", "block", "units", "sizes"])

    sent = B.each_block(blocks, send, "bucket int, block long, units binary, sizes binary")

    def number(key, table):
        """A bucket's distinct units in order as rows (uid, unit), and for each block the numbers of its units."""
        B.trim()
        lists = [_unpack(units, sizes) for units, sizes in zip(table["units"].to_pylist(), table["sizes"].to_pylist(), strict=True)]
        units = sorted(set(itertools.chain.from_iterable(lists)))
        of = dict(zip(units, range(len(units)), strict=True))
        uses = [B.pack_array(np.fromiter(map(of.__getitem__, x), np.uint32, len(x))) for x in lists]
        n, m = len(units), len(lists)
        columns = {
            "bucket": pa.array([key[0].as_py()] * (n + m), pa.int32()), "uid": pa.concat_arrays([pa.array((key[0].as_py() << 40) + np.arange(n)), pa.nulls(m, pa.int64())]),
            "unit": pa.concat_arrays([pa.array(units, pa.binary()).cast(pa.string()), pa.nulls(m, pa.string())]), "block": pa.concat_arrays([pa.nulls(n, pa.int64()), table["block"].combine_chunks().cast(pa.int64())]), "uses": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(uses, pa.binary())]),
        }
        return pa.table(columns)

    numbered = B.materialized(sent.groupBy("bucket").applyInArrow(number, "bucket int, uid long, unit string, block long, uses binary"))
    cuts = segmented(numbered.where("uid IS NOT NULL").select("uid", "unit"), vocabulary.table(), vocabulary.longest, vocabulary.merges, buckets)
    masks = B.materialized(cuts.withColumn("bucket", F.shiftright("uid", 40).cast("int")))

    def reply(key, table, found):
        B.trim()
        lists = found["mask"].combine_chunks().take(pa.array(np.argsort(found["uid"].to_numpy())))
        flat, begin = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        size = np.diff(begin)
        out = []
        for use in table["uses"].to_pylist():
            mine = B.unpack_array(use)
            out.append(B.squeeze(B._planes(flat[ranges(begin[mine], size[mine])], 8), 1))
        n = len(out)
        return pa.table({"block": table["block"], "kind": pa.array([MASKS] * n, pa.int32()), "bucket": pa.array([key[0].as_py()] * n, pa.int64()), "reply": pa.array(out, pa.binary())})

    uses = numbered.where("uid IS NULL").select("bucket", "block", "uses")
    answers = B.materialized(uses.groupBy("bucket").cogroup(masks.groupBy("bucket")).applyInArrow(reply, B.REPLY_SCHEMA))
    B.discard(numbered, masks)

    def turn(block, table):
        hashes, ids_of, byte_ids, joins, data = known.value
        units = Units(block, joins)
        raw, size = units.gathered()
        parts = [np.ascontiguousarray(np.frombuffer(B.expand(r), np.uint8).reshape(8, -1).T).view("<u8").ravel() for _, r in sorted(zip(table["bucket"].to_pylist(), table["reply"].to_pylist(), strict=True))]
        mask = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        # places of pieces in the bytes of the distinct units
        head = np.flatnonzero((raw & 0xC0) != 0x80)
        owner = np.repeat(np.arange(size.size), size)[head]
        length = np.bincount(owner, minlength=size.size)
        inner = np.arange(head.size) - (np.cumsum(length) - length)[owner]
        word = length // WORD + 1
        begin = head[(mask[(np.cumsum(word) - word)[owner] + inner // WORD] >> (inner % WORD).astype(np.uint64)) & np.uint64(1) > 0]
        end = np.append(begin[1:], raw.size)
        h = span_hashes(raw, begin, end)
        at = np.minimum(np.searchsorted(hashes, h), hashes.size - 1)
        hit = hashes[at] == h
        n = np.where(hit, 1, end - begin)
        flat = np.where(np.repeat(hit, n), np.repeat(ids_of[at], n), byte_ids[raw[ranges(begin, n)]])
        of_unit = np.repeat(np.arange(size.size), size)[begin]
        count = np.bincount(of_unit, weights=n, minlength=size.size).astype(np.int64)
        first, mine = np.cumsum(count) - count, units.back
        ids = flat[ranges(first[mine], count[mine])].astype(np.int32)
        cuts = np.concatenate([[0], np.cumsum(count[mine])])[units.bounds]
        back, sizes = decoded(ids, data)
        at = np.concatenate([[0], np.cumsum(sizes)])[cuts]
        if (at == units.offsets).all():
            differs = np.concatenate([[0], np.cumsum(back != units.buf)])
            same = np.diff(differs[at]) == 0
        else:
            same = np.array([np.array_equal(back[a:z], units.buf[i:j]) for (a, z), (i, j) in zip(itertools.pairwise(at), itertools.pairwise(units.offsets), strict=True)])
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
        return block.table.append_column("n_tokens", pa.array(np.diff(cuts))).append_column("ids", lists).append_column("round_trip", pa.array(same))

    # a block of empty texts gets no replies; cogroup still brings it
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return B.with_replies(blocks, answers, turn, schema)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """encoded with text decoded from ids (null for null); bytes that are no UTF-8 turn to replacement characters."""
    spark = encoded.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast(Vocabulary(model).data())
    encoded = encoded.drop("text")

    def read(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            raw, size = decoded(flat, data.value)
            count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])].tolist()
            joined = raw.tobytes()
            texts = [None if null else joined[a:z].decode("utf-8", "replace").removeprefix(" ") for (a, z), null in zip(itertools.pairwise(cut), lists.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(read, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def op2(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
