"""Sources: files, decoded and guarded; titles, messages, entries of Markdown, HTML and JSON."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.functions import rules
from proseloom.operators import lines as L

# Extensions and first bytes of files that hold no prose.
BINARY_EXTENSIONS = "png jpg jpeg gif bmp webp ico pdf zip gz tgz bz2 xz 7z rar exe dll so dylib class jar woff woff2 ttf otf mp3 mp4 mov avi wav ogg docx xlsx pptx sqlite db pyc".split()
MAGIC = {"89504E47": "PNG", "FFD8FF": "JPEG", "47494638": "GIF", "25504446": "PDF", "504B0304": "ZIP", "1F8B": "gzip", "425A68": "bzip2", "FD377A585A00": "xz", "377ABCAF271C": "7z", "52617221": "RAR", "7F454C46": "ELF", "4D5A": "PE", "CAFEBABE": "class file", "53514C697465": "SQLite"}


def binary_reason(path: Column, content: Column) -> Column:
    """Why a file is not read as prose (its extension, its first bytes, a NUL byte early on), or null."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    nul = F.position(F.lit("\x00"), F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0
    out = F.when(nul, F.lit("NUL byte"))
    for mark, name in reversed(MAGIC.items()):
        out = F.when(F.startswith(content, F.unhex(F.lit(mark))), F.lit(f"{name} signature")).otherwise(out)
    return F.when(extension.isin(*BINARY_EXTENSIONS), F.concat(F.lit("extension ."), extension)).otherwise(out)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, text, refused``: files under a folder, decoded with line ends as ``\\n``; a refused file has its reason and no text."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    reason = binary_reason(F.col("path"), F.col("content"))
    body = F.regexp_replace(F.try_validate_utf8(F.decode("content", "UTF-8")), "\r\n?", "\n")
    return found.select("path", reason.alias("refused"), "content").select("path", F.when(F.col("refused").isNull(), body).alias("text"), "refused")


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ``**`` any folders, ``*`` and ``?`` within one."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^(?:.*/)?{out}$"


def routed(path: Column, globs: list[tuple[str, str]], default: str = "default") -> Column:
    """The profile of the first glob that matches the path."""
    out = F.lit(default)
    for glob, profile in reversed(globs):
        out = F.when(path.rlike(glob_pattern(glob)), profile).otherwise(out)
    return out


def declared_profile(documents: DataFrame) -> DataFrame:
    """``doc_id, profile``: a ``writing-profile:`` line among the first ten."""
    found = L.lines(documents).where("line <= 10").select("doc_id", "line", F.regexp_extract("raw", r"(?i)writing-profile:\s*([\w-]+)", 1).alias("profile"))
    return found.where("profile != ''").groupBy("doc_id").agg(F.min_by("profile", "line").alias("profile"))


def messages(documents: DataFrame) -> DataFrame:
    """``doc_id, message, text``: a file of messages cut at lines of three to five hyphens; empty ones are left out."""
    parts = F.filter(F.transform(F.split("text", r"(?m)^-{3,5}\s*$", -1), lambda m: F.regexp_replace(m, r"^\s+|\s+$", "")), lambda m: m != "")
    return documents.select("doc_id", F.posexplode(parts).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("message"), "text")


def markdown_entries(documents: DataFrame) -> DataFrame:
    """``doc_id, entry_id, kind, text``: prose blocks, list items and quotes of Markdown texts; headings are no entries."""
    from proseloom.operators.series import blocks

    found = blocks(documents).where("kind in ('prose', 'list', 'quote')")
    items = found.select("doc_id", "block", "kind", F.posexplode(F.when(F.col("kind") == "list", F.split("text", r"\n(?=\s*(?:[-*+]|\d+\.)\s)", -1)).otherwise(F.array("text"))).alias("n", "t"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("t", rules.BULLET + r"|(?m)^\s*>\s?", ""), r"\s+", " "))
    return items.select("doc_id", F.concat_ws("-", F.col("doc_id").cast("string"), "block", "n").alias("entry_id"), "kind", bare.alias("text"))


# Elements whose text is an entry, and those that are skipped.
ENTRY_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd figcaption blockquote summary caption".split())
SKIPPED_TAGS = frozenset("script style code pre svg template noscript head".split())


#: Characters of entries that a task gathers before it hands them on.
ENTRY_CHARS = 1 << 20


class _Entries(HTMLParser):
    """Text by innermost entry element, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.stack, self.found = 0, [], []

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag in SKIPPED_TAGS:
            self.skip += 1
        elif tag in ENTRY_TAGS and not self.skip:
            if self.stack and self.stack[-1][0] == tag and tag in ("p", "li", "td", "th", "dt", "dd"):
                self.handle_endtag(tag)
            self.found.append([tag, ""])
            self.stack.append((tag, len(self.found) - 1))

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED_TAGS:
            self.skip = max(0, self.skip - 1)
        while tag in ENTRY_TAGS and any(t == tag for t, _ in self.stack):
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.stack and not self.skip:
            self.found[self.stack[-1][1]][1] += data


def html_entries(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """``page_id, n, tag, text``: the text of block elements of each page; scripts, styles and code are skipped, empty elements left out."""

    kinds = pa.schema([("page_id", pa.int64()), ("n", pa.int64()), ("tag", pa.string()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):  # one page at a time becomes a Python string, and entries leave by the megabyte
                parser = _Entries()
                parser.feed(batch.column(1)[k].as_py() or "")
                parser.close()
                kept = [(t, x) for t, found in parser.found if (x := " ".join(found.split()))]
                rows += [{"page_id": batch.column(0)[k].as_py(), "n": n, "tag": t, "text": x} for n, (t, x) in enumerate(kept, 1)]
                size += sum(len(x) for _, x in kept)
                if size >= ENTRY_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(column).cast("string").alias("html")).mapInArrow(read, "page_id long, n long, tag string, text string")


def json_entries(documents: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, path, text``: the string values of JSON objects and arrays, two levels deep, that read as prose (four words or more). Malformed JSON gives none."""
    top = F.from_json(F.col(column), "map<string,string>")
    values = documents.select("doc_id", F.explode(F.map_entries(top)).alias("e")).select("doc_id", F.col("e.key").alias("path"), F.col("e.value").alias("value"))
    nested = F.coalesce(F.map_entries(F.from_json("value", "map<string,string>")), F.transform(F.from_json("value", "array<string>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value"))))
    inner = values.where(F.trim("value").rlike(r"^[\[{]")).select("doc_id", "path", F.explode(nested).alias("e")).select("doc_id", F.concat_ws(".", "path", "e.key").alias("path"), F.col("e.value").alias("value"))
    return values.where(~F.trim("value").rlike(r"^[\[{]")).unionByName(inner).where(F.size(F.split(F.trim("value"), r"\s+")) >= 4).withColumnRenamed("value", "text")


def script_lines(documents: DataFrame) -> DataFrame:
    """``doc_id, line, speaker, text``: lines ``NAME: text`` or ``NAME. text`` of a script; a line without a name goes on with the last one."""
    from pyspark.sql import Window

    pattern = r"^\s*([A-Z][A-Z .'-]{1,30}|[A-Z][\w'-]{1,30})\s*[:.]\s+(\S.*)$"
    found = L.lines(documents).where(F.trim("raw") != "")
    named = found.select("doc_id", "line", F.when(F.col("raw").rlike(pattern), F.upper(F.trim(F.regexp_extract("raw", pattern, 1)))).alias("name"), F.when(F.col("raw").rlike(pattern), F.regexp_extract("raw", pattern, 2)).otherwise(F.trim("raw")).alias("text"))
    speaker = F.last("name", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line"))
    return named.select("doc_id", "line", speaker.alias("speaker"), "text").where("speaker is not null")
