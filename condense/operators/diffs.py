"""Diff sections, and structural differences of Python sources."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condense.operators.lines import joined, shown
from condense.operators.outlines import _declared
from condense.shipping import ship


def count_files(text: Column) -> Column:
    """How many files a diff changes."""
    return F.regexp_count(text, F.lit(r"(?m)^diff --git ")).cast("long")


def file_counts(lines: DataFrame) -> DataFrame:
    """(doc_id, files): how many files the diff in each document's shown lines changes; no text is put together."""
    return lines.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(shown(), count_files(F.col("line")))), F.lit(0)).alias("files"))


#: A text's pieces, each but the first one file's.
PIECES = r"\n(?=diff --git )"
#: So many positions of a document are split in one piece of work.
CHUNK = 4096


def diff_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, section, old_path, new_path, is_added, is_deleted, is_binary, has_hunks, added_lines, removed_lines, body) for each file."""
    pieces = F.split(F.concat(F.lit("\n"), text), PIECES)
    return described(docs.select("doc_id", F.posexplode(pieces).alias("section", "body")))


def line_sections(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows that diff_sections has for the rendered lines; no task holds a document, only chunks of it and whole sections."""
    # null documents are equal as fields of a struct, so one exchange serves the chunks and the join
    chunks = lines.where(shown() & F.col("line").isNotNull()).groupBy(F.struct("doc_id").alias("d"), F.floor(F.col("pos") / chunk).alias("chunk")).agg(joined(F.struct("pos", "line")).alias("text"))
    chunks = chunks.select("d", "chunk", F.split(F.concat(F.lit("\n"), "text"), PIECES).alias("pieces"))
    before = F.sum("n").over(W.partitionBy("d").orderBy("chunk")) - F.col("n")
    counts = chunks.select("d", "chunk", (F.size("pieces") - 1).alias("n")).select("d", "chunk", before.cast("int").alias("before"))
    # a chunk's first piece goes on with the last section before it
    each = chunks.join(counts, ["d", "chunk"]).select("d", "chunk", "before", F.posexplode("pieces").alias("i", "part")).where("part <> ''")
    each = each.select("d", (F.col("before") + F.col("i")).alias("section"), F.struct("chunk", "part").alias("p")).where("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "")
    return described(each.groupBy("d", "section").agg(body.alias("body")).select("d.doc_id", "section", "body"))


def described(sections: DataFrame) -> DataFrame:
    """What the head and the hunks of each (doc_id, section, body) say; other bodies are left out."""
    rows = sections.where(F.col("body").startswith("diff --git "))
    body = F.col("body")
    head = F.regexp_extract(body, r"(?s)^(.*?)(?=\n@@ |\z)", 1)
    name = lambda i: F.regexp_extract(body, r"^diff --git a/(.*?) b/(.*)", i)
    moved = lambda word, i: F.coalesce(F.nullif(F.regexp_extract(head, rf"(?m)^rename {word} (.+)$", 1), F.lit("")), name(i))
    return rows.select(
        "doc_id", "section", moved("from", 1).alias("old_path"), moved("to", 2).alias("new_path"), head.rlike("(?m)^new file mode").alias("is_added"), head.rlike("(?m)^deleted file mode").alias("is_deleted"),
        head.rlike("(?m)^Binary files .* differ").alias("is_binary"), body.rlike("(?m)^@@ ").alias("has_hunks"),
        F.regexp_count(F.regexp_extract(body, r"(?s)\n(@@ .*)$", 1), F.lit(r"(?m)^\+")).cast("long").alias("added_lines"), F.regexp_count(F.regexp_extract(body, r"(?s)\n(@@ .*)$", 1), F.lit("(?m)^-")).cast("long").alias("removed_lines"), "body",
    )


ORDER = ("removed", "extracted", "inlined", "modified", "renamed", "moved", "reordered", "added")


def structural_changes(old: str, new: str) -> tuple[str, list[dict]]:
    """(class of change, operations): unparseable, formatting-only, import-only or structural."""
    try:
        trees = ast.parse(old), ast.parse(new)
    except (SyntaxError, ValueError, RecursionError):
        return "unparseable", []
    if ast.dump(trees[0]) == ast.dump(trees[1]):
        return "formatting-only", []
    rest = [[ast.dump(n) for n in t.body if not isinstance(n, ast.Import | ast.ImportFrom)] for t in trees]
    if rest[0] == rest[1]:
        return "import-only", []

    def declared(tree: ast.Module) -> dict[tuple[str, str], tuple[str, int, int]]:
        out = {}
        for k, (node, owner) in enumerate(_declared(tree)):
            plain = ast.dump(ast.Module(body=node.body, type_ignores=[])) + (ast.dump(node.args) if not isinstance(node, ast.ClassDef) else "")
            out[(owner.name if owner else "", node.name)] = (plain, k, (node.end_lineno or node.lineno) - node.lineno + 1)
        return out

    a, b = map(declared, trees)
    gone, come = {k: v for k, v in a.items() if k not in b}, {k: v for k, v in b.items() if k not in a}
    label = lambda key: ".".join(filter(None, key))
    ops: list[dict] = []
    for key, (dump, _, lines) in list(gone.items()):
        # content alone tells a rename or a move only from three lines on
        same = [k for k, v in come.items() if v[0] == dump and lines >= 3]
        if same:
            other = same[0]
            ops.append({"op": "renamed" if key[0] == other[0] else "moved", "name": label(key), "detail": label(other)})
            del gone[key], come[other]
    for key, v in a.items():
        if key in b and b[key][0] != v[0]:
            ops.append({"op": "modified", "name": label(key), "detail": None})
    common = [k for k in a if k in b]
    if [k for k in sorted(common, key=lambda k: a[k][1])] != [k for k in sorted(common, key=lambda k: b[k][1])]:
        ops.append({"op": "reordered", "name": "", "detail": None})
    ops += [{"op": "removed", "name": label(k), "detail": None} for k in gone] + [{"op": "added", "name": label(k), "detail": None} for k in come]
    return "structural", sorted(ops, key=lambda o: (ORDER.index(o["op"]), o["name"]))


def structural_diff(pairs: DataFrame, key: str = "path") -> DataFrame:
    """(key, change, ops) for rows (key, old_text, new_text)."""
    ship(pairs.sparkSession)

    def apply(batches):
        kind = pa.list_(pa.struct([("op", pa.string()), ("name", pa.string()), ("detail", pa.string())]))
        for batch in batches:
            found = [structural_changes(o or "", n or "") for o, n in zip(batch["old_text"].to_pylist(), batch["new_text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], kind)], [key, "change", "ops"])

    return pairs.select(key, "old_text", "new_text").mapInArrow(apply, f"{key} string, change string, ops array<struct<op:string,name:string,detail:string>>")


#: Larger files aren't compared.
MOST_BYTES = 256 * 1024


def told(change: str, ops: list[dict]) -> str | None:
    """The operations of a structural difference as lines; null where there is nothing to tell."""
    if change == "unparseable":
        return None
    lines = [f"  {o['op']}: {o['name']}".rstrip(": ") + (f" -> {o['detail']}" if o["detail"] else "") for o in ops]
    return "\n".join([f"[{change}]", *lines])


def enriched(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """docs(doc_id, text) where the hunks of changed Python files give way to what changed in them, if that is shorter.

    contents: (doc_id, old_path, new_path, old_text, new_text), whole texts of files on both sides of a diff.
    Added, deleted, binary and other files, files without contents, too large or not parseable keep their hunks.
    """
    ship(docs.sparkSession)
    found = diff_sections(docs).where("has_hunks and not is_binary and not is_added and not is_deleted")
    found = found.where(F.col("old_path").rlike(r"\.pyi?$") & F.col("new_path").rlike(r"\.pyi?$")).select("doc_id", "section", "old_path", "new_path")
    small = (F.octet_length("old_text") <= MOST_BYTES) & (F.octet_length("new_text") <= MOST_BYTES)
    pairs = found.join(contents.where(small), ["doc_id", "old_path", "new_path"]).select("doc_id", "section", "old_text", "new_text")

    def apply(batches):
        for batch in batches:
            texts = [told(*structural_changes(o, n)) for o, n in zip(batch["old_text"].to_pylist(), batch["new_text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["section"], pa.array(texts, pa.string())], ["doc_id", "section", "told"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    changes = pairs.mapInArrow(apply, f"doc_id {kind}, section int, told string")
    # the text before the first section is a piece of its own
    pieces = docs.select("doc_id", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), r"\n(?=diff --git )", -1)).alias("section", "body"))
    head = F.regexp_extract("body", r"(?s)^(.*?)(?=\n@@ |\z)", 1)
    short = F.concat(head, F.lit("\n"), "told")
    body = F.when(F.length(short) < F.length("body"), short).otherwise(F.col("body"))
    both = pieces.join(changes, ["doc_id", "section"], "left").select("doc_id", F.struct("section", body.alias("body")).alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["body"]), "\n")
    return both.groupBy("doc_id").agg(F.substring(whole, 2, 2147483647).alias("text"))
