"""Parsers over files made of the tables' rows, a file a group."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.sizes import PARTITIONS, spread
from quern.plans.tables import table
from quern.sources import files

#: Lines of a page.
LINES = 30


def _read(given: DataFrame) -> DataFrame:
    """What the parsers make of rows (external_id, content)."""
    got = files.parsed(given.select("external_id", "content"))
    path = F.array_join(F.transform("headings", lambda h: F.concat(h["level"].cast("string"), F.lit("@"), h["start"].cast("string"), F.lit(":"), h["text"])), ";")
    return got.select("external_id", "title", "parser", F.sha2("text", 256).alias("text_hash"), F.char_length("text").alias("n_chars"), path.alias("headings"), F.array_join("warnings", ";").alias("warnings"), "published_at", "error")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size"))


def read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as Markdown files with returns before their line feeds."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    whole = F.concat(F.lit("## "), F.col("role"), F.lit("  ##\n\nTurn\n=====\n\n"), F.regexp_replace("text", r"[#>|=-]", "."))
    return _read(c.select(F.concat_ws("", F.lit("c"), "conv_id", F.lit("/"), "turn", F.lit(".md")).alias("external_id"), F.encode(F.replace(whole, F.lit("\n"), F.lit("\r\n")), "utf-8").alias("content")))


def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of each brand's parts, with quotes and bars in its cells."""
    row = F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), F.col("p_name"), F.lit(', ""x"""'), F.lit(","), F.col("p_type"), F.lit("|y"))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r"))))["r"].alias("rs"))
    return _read(rows.select(F.concat("p_brand", F.lit(".csv")).alias("external_id"), F.encode(F.concat(F.lit("key,name,kind\n\n"), F.array_join("rs", "\n")), "utf-8").alias("content")))


def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as objects, and each brand's as lines of objects."""
    p = _parts(spark, sf_dir).select("p_brand", "p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_partkey").alias("key"), F.array("p_size", F.lit(1)).alias("ab"))).alias("j"))
    each = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("external_id"), F.col("j").alias("t"))
    lines = p.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(F.struct("p_partkey", "j")))["j"], "\n\n").alias("t")).select(F.concat("p_brand", F.lit(".jsonl")).alias("external_id"), "t")
    return _read(each.unionByName(lines).select("external_id", F.encode("t", "utf-8").alias("content")))


def read_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as mails of the tenth of May."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    head = F.concat(F.lit("From: "), F.col("role"), F.lit("@x.example\r\nTo: b@x.example\r\nSubject: Turn "), F.col("turn").cast("string"), F.lit("\r\nDate: Fri, 10 May 2024 10:00:00 +0000\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"))
    return _read(c.select(F.concat_ws("", F.lit("c"), "conv_id", F.lit("-"), "turn", F.lit(".eml")).alias("external_id"), F.encode(F.concat(head, F.replace("text", F.lit("\n"), F.lit("\r\n"))), "utf-8").alias("content")))


def read_rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading, characters by code, and hidden text."""
    body = F.concat(F.lit(r"{\rtf1\ansi\ansicpg1252{\fonttbl f}{\stylesheet{\s1 heading 1;}}\pard\s1 "), F.col("p_name"), F.lit(r"\par\pard caf\'e9 \u8212?{\v unseen}"), F.col("p_type"), F.lit(r"\par}"))
    return _read(_parts(spark, sf_dir).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".rtf")).alias("external_id"), F.encode(body, "utf-8").alias("content")))


def read_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headings, entities, what is dropped and what is hidden."""
    body = F.concat(F.lit("<html><head><title> A  "), F.col("p_name"), F.lit("</title><style>p {}</style></head><body><h1>Part <b>"), F.col("p_partkey").cast("string"), F.lit("</b></h1><p>one &amp; two<br>three</p><script>no()</script><p style='display: none'>un <i>seen</i></p><!-- said --><div>"), F.col("p_type"), F.lit("</div></body></html>"))
    return _read(_parts(spark, sf_dir).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".html")).alias("external_id"), F.encode(body, "utf-8").alias("content")))


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def _links(*targets: str) -> str:
    each = "".join(f'<Relationship Id="r{i}" Type="t" Target="{t}"/>' for i, t in enumerate(targets, 1))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{each}</Relationships>'


def _docx(brand: str, rows: list[str]) -> bytes:
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={style!r}/></w:pPr>" if style else ""}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>'
    cells = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    body = p(brand, "Heading1") + p(f"{len(rows)} parts") + "<w:tbl>" + cells("key", "name") + "".join(cells(*r.split("\t")) for r in rows) + "</w:tbl>"
    return _zip({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>"})


def _xlsx(brand: str, rows: list[str]) -> bytes:
    names = sorted({r.split("\t")[1] for r in rows})
    shared = "".join(f"<si><t>{escape(n)}</t></si>" for n in names)
    cells = "".join(f'<row r="{i}"><c r="A{i}"><v>{r.split("\t")[0]}</v></c><c r="C{i}" t="s"><v>{names.index(r.split("\t")[1])}</v></c></row>' for i, r in enumerate(rows, 1))
    return _zip({
        "xl/workbook.xml": f'<workbook {_S} {_R}><sheets><sheet name="{escape(brand)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _links("worksheets/sheet1.xml"), "xl/sharedStrings.xml": f"<sst {_S}>{shared}</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{cells}</sheetData></worksheet>",
    })


def _pptx(brand: str, rows: list[str]) -> bytes:
    shape = lambda lines, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines) + "</p:txBody></p:sp>"
    slide = lambda *shapes: f"<p:sld {_P} {_A}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
    return _zip({
        "ppt/presentation.xml": f'<p:presentation {_P} {_R}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _links("slides/slide1.xml"), "ppt/slides/slide1.xml": slide(shape([brand], '<p:ph type="title"/>'), shape([r.split("\t")[1] for r in rows])),
        "ppt/slides/_rels/slide1.xml.rels": _links("../notesSlides/notesSlide1.xml"), "ppt/notesSlides/notesSlide1.xml": f"<p:notes {_P} {_A}><p:cSld><p:spTree>{shape([f'{len(rows)} parts'])}</p:spTree></p:cSld></p:notes>",
    })


def _pdf(brand: str, rows: list[str]) -> bytes:
    """Pages of ``LINES`` parts; every second one by a font of two-byte codes of its own."""
    pages = [rows[i : i + LINES] for i in range(0, len(rows), LINES)]
    letters = sorted({c for r in rows for c in r.split("\t")[1]})
    code = {c: i + 1 for i, c in enumerate(letters)}
    cmap = "1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n%d beginbfchar\n%s\nendbfchar" % (len(letters), "\n".join(f"<{i:04X}> <{ord(c):04X}>" for c, i in code.items()))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), len(pages))}
    objects |= {3: b"<< /Type /Font /BaseFont /Helvetica >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>", 5: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap.encode())}
    for i, lines in enumerate(pages):
        names = [r.split("\t")[1] for r in lines]
        shown = [b"<" + "".join(f"{code[c]:04X}" for c in n).encode() + b"> Tj" if i % 2 else b"(" + n.encode() + b") Tj" for n in names]
        stream = zlib.compress(b"BT /F%d 12 Tf 72 720 Td " % (1 + i % 2) + b" T* ".join(shown) + b" ET")
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 100] /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream)
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items()))


def _nested(brand: str, rows: list[str]) -> bytes:
    inner = _zip({"c.txt": f"{len(rows)} parts"})
    return _zip({"a.txt": brand, "sub/b.csv": "key,name\n" + rows[0].replace("\t", ","), "inner.zip": inner, "skipped/": b""})


def _evil(brand: str, rows: list[str]) -> bytes:
    return _zip({"a.txt": brand, "../up.txt": "x"})


def _made(build: Callable[[str, list[str]], bytes]) -> Callable[[Column, Column], Column]:
    return F.pandas_udf(lambda brand, rows: pd.Series([build(b, list(r)) for b, r in zip(brand, rows)]), "binary")


def _apart(groups: DataFrame, brands: DataFrame) -> DataFrame:
    """Each brand a partition of its own: a brand's file is as large as the table makes it,
    and one worker must not hold several."""
    return groups.repartition(min(max(1, brands.select("p_brand").distinct().count()), PARTITIONS))


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand with its parts: key, tab, name."""
    row = F.concat(F.col("p_partkey").cast("string"), F.lit("\t"), F.col("p_name"))
    own = table(spark, sf_dir, "part").where("p_brand IS NOT NULL")
    return _apart(own.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r"))))["r"].alias("rows")), own)


def _packed(suffix: str, build: Callable[[str, list[str]], bytes]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read(_brands(spark, sf_dir).select(F.concat("p_brand", F.lit(suffix)).alias("external_id"), _made(build)("p_brand", "rows").alias("content")))

    return query


def read_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives in archives are opened; one that climbs is refused whole."""
    b = _brands(spark, sf_dir)
    kind = lambda name, build: b.select(F.concat("p_brand", F.lit(name)).alias("external_id"), F.concat(F.lit("file:///"), "p_brand", F.lit(name)).alias("uri"), _made(build)("p_brand", "rows").alias("content"))
    members = files.expanded(kind(".zip", _nested).unionByName(kind("-bad.zip", _evil)))
    read = _read(members.where("error IS NULL")).select("external_id", "parser", "text_hash", F.lit(False).alias("refused"))
    return read.unionByName(members.where("error IS NOT NULL").select("external_id", F.lit(None).cast("string").alias("parser"), F.lit(None).cast("string").alias("text_hash"), F.startswith("error", F.lit("ArchiveRefused")).alias("refused")))


QUERIES = {f.__name__: f for f in (read_text, read_csv, read_json, read_mail, read_rtf, read_html, read_zip)}
QUERIES |= {f"read_{s}": _packed(f".{s}", build) for s, build in (("docx", _docx), ("xlsx", _xlsx), ("pptx", _pptx), ("pdf", _pdf))}

_N = "chr(10)"


def _sql(rows: str, external_id: str, title: str, parser: str, headings: str = "''", warnings: str = "''", published: str = "NULL") -> str:
    """``rows``: a query with a column t, the text."""
    return f"""SELECT {external_id} AS external_id, {title} AS title, '{parser}' AS parser, sha256(t) AS text_hash, CAST(length(t) AS INT) AS n_chars, {headings} AS headings, {warnings} AS warnings, CAST({published} AS VARCHAR) AS published_at, CAST(NULL AS VARCHAR) AS error FROM ({rows})"""


def _table(head: str, row: str) -> str:
    rule = "| " + " | ".join(["---"] * len(head.split("|"))) + " |"
    return f"'| {head} |' || {_N} || '{rule}' || {_N} || string_agg({row}, {_N} ORDER BY p_partkey)"


_PLAIN = "'| ' || p_partkey || ' | ' || p_name || ' |'"
_BRANDS = "FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand"
_OBJECT = f"'{{' || {_N} || '  \"ab\": [' || {_N} || '    ' || p_size || ',' || {_N} || '    1' || {_N} || '  ],' || {_N} || '  \"key\": ' || p_partkey || ',' || {_N} || '  \"name\": \"' || p_name || '\"' || {_N} || '}}'"
SQL = {
    "read_text": _sql(f"SELECT conv_id, turn, role, '## ' || role || '  ##' || {_N} || {_N} || 'Turn' || {_N} || '=====' || {_N} || {_N} || regexp_replace(text, '[#>|=-]', '.', 'g') AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL", "'c' || conv_id || '/' || turn || '.md'", "role", "text", "'2@0:' || role || ';1@' || (length(role) + 9) || ':Turn'"),
    "read_csv": _sql(f"""SELECT p_brand, {_table('key | name | kind', "'| ' || p_partkey || ' | ' || p_name || ', \"x\" | ' || p_type || '\\|y |'")} AS t FROM part GROUP BY p_brand""", "p_brand || '.csv'", "p_brand || '.csv'", "csv"),
    "read_json": _sql(f"SELECT 'p' || p_partkey || '.json' AS x, {_OBJECT} AS t FROM part UNION ALL SELECT p_brand || '.jsonl', string_agg({_OBJECT}, {_N} ORDER BY p_partkey) FROM part GROUP BY p_brand", "x", "x", "json"),
    "read_mail": _sql(f"SELECT conv_id, turn, 'From: ' || role || '@x.example' || {_N} || 'To: b@x.example' || {_N} || 'Date: Fri, 10 May 2024 10:00:00 +0000' || {_N} || 'Subject: Turn ' || turn || {_N} || {_N} || trim(text, {_N}) || {_N} AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL", "'c' || conv_id || '-' || turn || '.eml'", "'Turn ' || turn", "mail", published="'2024-05-10'"),
    "read_rtf": _sql(f"SELECT p_partkey, p_name, p_name || {_N} || 'café —' || p_type || {_N} AS t FROM part", "'p' || p_partkey || '.rtf'", "p_name", "rtf", "'1@0:' || p_name", "'hidden:' || (length(p_name) + 7) || ':unseen'"),
    "read_html": _sql(f"SELECT p_partkey, p_name, 'Part' || {_N} || p_partkey || {_N} || {_N} || 'one & two' || {_N} || 'three' || {_N} || {_N} || p_type || {_N} AS t FROM part", "'p' || p_partkey || '.html'", "'A ' || p_name", "html", "'1@0:Part ' || p_partkey", "'hidden:' || (24 + length(CAST(p_partkey AS VARCHAR))) || ':un seen;hidden:' || (24 + length(CAST(p_partkey AS VARCHAR))) || ':said'"),
    "read_docx": _sql(f"SELECT p_brand, p_brand || {_N} || {_N} || count(*) || ' parts' || {_N} || {_N} || {_table('key | name', _PLAIN)} || {_N} || {_N} AS t {_BRANDS}", "p_brand || '.docx'", "p_brand", "docx", "'1@0:' || p_brand"),
    "read_xlsx": _sql(f"SELECT p_brand, '## ' || p_brand || {_N} || {_N} || string_agg('| ' || p_partkey || ' |  | ' || p_name || ' |' || CASE WHEN p_partkey = lead_key THEN {_N} || '| --- | --- | --- |' ELSE '' END, {_N} ORDER BY p_partkey) || {_N} || {_N} AS t FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand) AS lead_key FROM part WHERE p_brand IS NOT NULL) GROUP BY p_brand", "p_brand || '.xlsx'", "p_brand || '.xlsx'", "xlsx", "'1@0:' || p_brand"),
    "read_pptx": _sql(f"SELECT p_brand, '## Slide 1: ' || p_brand || {_N} || string_agg(p_name, {_N} ORDER BY p_partkey) || {_N} || '[speaker notes] ' || count(*) || ' parts' || {_N} || {_N} AS t {_BRANDS}", "p_brand || '.pptx'", "p_brand || '.pptx'", "pptx", "'2@0:Slide 1: ' || p_brand"),
    "read_pdf": _sql(f"SELECT p_brand, string_agg(p, {_N} || {_N} ORDER BY page) AS t FROM (SELECT p_brand, page, string_agg(p_name, {_N} ORDER BY p_partkey) AS p FROM (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // {LINES} AS page FROM part WHERE p_brand IS NOT NULL) GROUP BY p_brand, page) GROUP BY p_brand", "p_brand || '.pdf'", "p_brand || '.pdf'", "pdf"),
    "read_zip": f"""
WITH b AS (SELECT p_brand, count(*) AS n, arg_min(p_partkey || ' | ' || p_name, p_partkey) AS r {_BRANDS})
SELECT p_brand || '.zip!a.txt' AS external_id, 'text' AS parser, sha256(p_brand) AS text_hash, false AS refused FROM b
UNION ALL SELECT p_brand || '.zip!sub/b.csv', 'csv', sha256('| key | name |' || {_N} || '| --- | --- |' || {_N} || '| ' || r || ' |'), false FROM b
UNION ALL SELECT p_brand || '.zip!inner.zip!c.txt', 'text', sha256(n || ' parts'), false FROM b
UNION ALL SELECT p_brand || '-bad.zip', NULL, NULL, true FROM b
""",
}
