"""Exports: CSV lines, workbook, report, graph files, sitemap archives. Bounded ones are built on the driver."""

from __future__ import annotations

import gzip
import html
import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import numbered, write_lines
from .summary import health_histogram, issues_by_category, key_findings, summary
from .views import ALL, HEADERS, SHEETS, SITE_STRUCTURE, TABS, cell, csv_value, flag, needs_spider

c = F.col
REPORT_ROWS, LIST_ROWS = 1000, 100
#: Rows that the format lets a sheet hold, its header among them.
SHEET_ROWS = 1_048_576


def csv_cell(text: Column) -> Column:
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(audited: DataFrame, column_ids: list[str] = ALL) -> DataFrame:
    """(id, line) of each row."""
    rows = audited.select("id", *[x.alias(f"v{k}") for k, x in enumerate(_cells(audited, column_ids))])
    kinds = dict(rows.dtypes)
    return rows.select("id", F.concat_ws(",", *[csv_cell(csv_value(c(f"v{k}"), kinds[f"v{k}"])) for k in range(len(column_ids))]).alias("line"))


def _cells(audited: DataFrame, column_ids: list[str]) -> list[Column]:
    """Columns of the table; spider columns are null where no crawl gave them."""
    spider = "spider" in audited.columns
    return [cell(i) if spider or not needs_spider(i) else F.lit(None).cast("string") for i in column_ids]


def csv_header(column_ids: list[str]) -> str:
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(ch in s for ch in '",\n\r') else s
    return ",".join(quote(HEADERS[i]) for i in column_ids)


def write_csv(audited: DataFrame, path: str, tab: str | None = None) -> str:
    """CSV files with a byte order mark, CRLF and one header, in order of id; partitions are files that join in order."""
    ids = TABS[tab] if tab else ALL
    spark = audited.sparkSession
    head = spark.createDataFrame([(-(1 << 62), "﻿" + csv_header(ids))], "id long, line string")
    head.unionByName(csv_lines(audited, ids)).repartitionByRange("id").sortWithinPartitions("id").select("line").write.option("lineSep", "\r\n").text(path)
    return path


# ---------------------------------------------------------------- workbook

def _column_name(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def _sheet(rows: list[list], fills: list[list[int]] | None = None) -> str:
    out = []
    for r, row in enumerate(rows, 1):
        cells = []
        for k, v in enumerate(row):
            style = fills[r - 1][k] if fills else 0
            at = f'r="{_column_name(k)}{r}" s="{style}"'
            if v is None or v == "":
                cells.append(f"<c {at}/>")
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f"<c {at}><v>{v}</v></c>")
            else:
                text = "".join(ch for ch in str(v) if ch >= " " or ch in "\t\n")[:32767]
                cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>'


def workbook_bytes(sheets: Iterable[tuple[str, tuple[list[list], list[list[int]] | None]]]) -> bytes:
    """A minimal spreadsheet file; styles 1 and 2 are the fills of warning and critical cells, 3 a bold header. One sheet is held at a time."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, sheet in sheets:
            names.append(name)
            z.writestr(f"xl/worksheets/sheet{len(names)}.xml", _sheet(*sheet))
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="rId{len(names) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        fill = lambda rgb: f'<fill><patternFill patternType="solid"><fgColor rgb="{rgb}"/></patternFill></fill>'
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill("FFFEF3C7")}{fill("FFFEE2E2")}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fillId="2" applyFill="1"/><xf fillId="3" applyFill="1"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
    return out.getvalue()


def _cell_text(v: object) -> object:
    return ("Yes" if v else "No") if isinstance(v, bool) else " | ".join(map(str, v)) if isinstance(v, list) else v


def build_workbook(audited: DataFrame, sheet_rows: int = SHEET_ROWS) -> bytes:
    """Summary of all rows and one sheet a group, with flagged cells filled; what is beyond sheet_rows goes on in further sheets."""
    return workbook_bytes(_sheets(audited, sheet_rows))


def _sheets(audited: DataFrame, sheet_rows: int) -> Iterator[tuple[str, tuple[list[list], list[list[int]] | None]]]:
    s = summary(audited).first().asDict()
    yield "Summary", ([["Metric", "Value"], *[[k, v] for k, v in s.items()]], None)
    structure = {"Site Structure": SITE_STRUCTURE} if "spider" in audited.columns else {}
    level = {None: 0, "warning": 1, "critical": 2}
    for name, ids in {**SHEETS, **structure}.items():
        got = audited.select("id", *[x.alias(f"v{k}") for k, x in enumerate(_cells(audited, ids))], *[flag(i).alias(f"f{k}") for k, i in enumerate(ids)])
        order = [c("v1").asc_nulls_last(), c("v0"), c("id")] if name == "Site Structure" else [c("id")]
        head = lambda: ([[HEADERS[i] for i in ids]], [[3] * len(ids)])  # noqa: B023, E731
        (rows, fills), nth = head(), 1
        for r in got.orderBy(*order).toLocalIterator():
            if len(rows) == sheet_rows:
                yield _nth_name(name, nth), (rows, fills)
                (rows, fills), nth = head(), nth + 1
            rows.append([_cell_text(r[f"v{k}"]) for k in range(len(ids))])
            fills.append([level[r[f"f{k}"]] for k in range(len(ids))])
        yield _nth_name(name, nth), (rows, fills)


def _nth_name(name: str, nth: int) -> str:
    return name if nth == 1 else f"{name[:22]} ({nth})"


# ---------------------------------------------------------------- report

def structure_rows(audited: DataFrame) -> DataFrame:
    """(position, url, depth, health_score, status, inbound, outbound): the first REPORT_ROWS pages by depth and arrival."""
    rows = audited.orderBy("spider.depth", "id").limit(REPORT_ROWS)
    order = Window.orderBy("depth", "id")  # REPORT_ROWS rows
    return rows.select("id", "url", c("spider.depth").alias("depth"), "health_score", c("http.status_code").alias("status"), c("spider.inbound_internal").alias("inbound"), c("spider.outbound_internal").alias("outbound")).withColumn("position", F.row_number().over(order)).drop("id")


def structure_lists(audited: DataFrame) -> dict[str, tuple[int, list[str]]]:
    """Number and first LIST_ROWS urls of orphans and of dead ends."""
    out = {}
    for name, field in (("Orphan pages", "is_orphan"), ("Dead ends", "is_dead_end")):
        found = audited.where(c(f"spider.{field}"))
        out[name] = (found.count(), [r.url for r in found.orderBy("id").limit(LIST_ROWS).select("url").collect()])
    return out


def _structure(audited: DataFrame) -> str:
    e = lambda x: html.escape(str(x))
    rows = "".join(f'<div style="padding-left:{2 * r.depth}em">{r.health_score} · {"ERR" if r.status is None else r.status} · {e(r.url)} in:{r.inbound} out:{r.outbound}</div>' for r in structure_rows(audited).orderBy("position").collect())
    lists = "".join(f"<details><summary>{name} ({n})</summary><ul>{''.join(f'<li>{e(u)}</li>' for u in urls) or '<li>None</li>'}</ul></details>" for name, (n, urls) in structure_lists(audited).items())
    return f"<h2>Site Structure</h2>{rows}{lists}"


def build_report(audited: DataFrame, title: str = "Site audit") -> str:
    """An HTML page of figures, histogram, findings, categories and at most REPORT_ROWS pages."""
    e = lambda x: html.escape(str(x))
    one = summary(audited).first().asDict()
    found = [r.finding for r in key_findings(summary(audited)).orderBy("position").collect()]
    bars = [r.n for r in health_histogram(audited).orderBy("bucket").collect()]
    top = max([1, *bars])
    svg = "".join(f'<rect x="{10 + i * 60}" y="{110 - 100 * n / top:.1f}" width="50" height="{100 * n / top:.1f}"/><text x="{35 + i * 60}" y="125" text-anchor="middle">{label}: {n}</text>' for i, (n, label) in enumerate(zip(bars, ("0-29", "30-49", "50-69", "70-89", "90-100"), strict=True)))
    cats = "".join(f"<tr><td>{e(r.category)}</td><td>{r.critical}</td><td>{r.warning}</td></tr>" for r in issues_by_category(audited).collect())
    pages = audited.orderBy("id").limit(REPORT_ROWS).select("url", "health_score", c("http.status_code").alias("status"), "issues").collect()
    parts = "".join(f"<section><h3>{e(r.url)}</h3><p>{r.health_score} · {'' if r.status is None else r.status}</p><ul>{''.join(f'<li class={i.severity}>{e(i.message)}</li>' for i in r.issues)}</ul></section>" for r in pages)
    structure = _structure(audited) if "spider" in audited.columns else ""
    total = one["total"] if "total" in one else audited.count()
    note = f"<p>Showing first {REPORT_ROWS} of {total} URLs.</p>" if total > REPORT_ROWS else ""
    cards = "".join(f"<div><b>{e(v)}</b> {e(k)}</div>" for k, v in one.items())
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1>{cards}<svg viewBox="0 0 310 130">{svg}</svg><ul>{"".join(f"<li>{e(f)}</li>" for f in found)}</ul><table>{cats}</table>{structure}{note}{parts}</body></html>'


# ---------------------------------------------------------------- graph

def _attr(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def _fixed(spark: SparkSession, lines: dict[int, str]) -> DataFrame:
    return spark.createDataFrame([(section, 0, text) for section, text in lines.items()], "section int, position long, line string")


#: Attributes of a node in a GEXF file (id, title, type).
GEXF_ATTRIBUTES = (("depth", "depth", "integer"), ("status", "status", "integer"), ("health", "healthScore", "integer"), ("title", "pageTitle", "string"), ("group", "group", "string"))


def gexf_lines(nodes: DataFrame, edges: DataFrame, root_url: str, as_of: str = "2024-01-01") -> DataFrame:
    """(section, position, line) of a GEXF 1.3 document; edges are numbered from 0 in order of source and target."""
    value = lambda k, x: F.concat(F.lit(f'<attvalue for="{k}" value="'), x, F.lit('"/>'))
    title = F.coalesce("title", F.lit(""))
    values = [value("depth", c("depth").cast("string")), value("status", F.coalesce("status", F.lit(0)).cast("string")), value("health", c("health_score").cast("string")), value("title", _attr(title)), value("group", _attr(F.coalesce("group", F.lit(""))))]
    node = F.concat(F.lit('<node id="'), _attr(c("url")), F.lit('" label="'), _attr(F.when(title != "", title).otherwise(c("url"))), F.lit('"><attvalues>'), *values, F.lit("</attvalues></node>"))
    edge = F.concat(F.lit('<edge id="'), c("position").cast("string"), F.lit('" source="'), _attr(c("source")), F.lit('" target="'), _attr(c("target")), F.lit('"><attvalues>'), value("type", c("type")), F.lit("</attvalues></edge>"))
    about = "".join(f'<attribute id="{i}" title="{t}" type="{k}"/>' for i, t, k in GEXF_ATTRIBUTES)
    safe = escape(root_url, {'"': "&quot;"})
    fixed = {
        0: f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<meta lastmodifieddate="{as_of[:10]}"><description>Site graph for {safe}</description></meta>\n<graph mode="static" defaultedgetype="directed">\n<attributes class="node">{about}</attributes>\n<attributes class="edge"><attribute id="type" title="type" type="string"/></attributes>\n<nodes>',
        2: "</nodes>\n<edges>", 4: "</edges>\n</graph>\n</gexf>",
    }
    numbers = lambda section, df, line: df.select(F.lit(section).alias("section"), "position", line.alias("line"))
    n, e = numbered(nodes, ["id", "url"]), numbered(edges, ["source", "target", "type"])
    return _fixed(nodes.sparkSession, fixed).unionByName(numbers(1, n, node)).unionByName(numbers(3, e, edge))


def graph_json_lines(nodes: DataFrame, edges: DataFrame, meta: DataFrame) -> DataFrame:
    """(section, position, line) of a JSON document {nodes, edges, metadata}."""
    def items(section: int, df: DataFrame, keys: list[str]) -> DataFrame:
        row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        return numbered(df, keys).select(F.lit(section).alias("section"), "position", F.concat(F.when(c("position") > 0, ",").otherwise(""), row).alias("line"))

    about = meta.select(F.lit(5).alias("section"), F.lit(0).cast("long").alias("position"), F.to_json(F.struct(*meta.columns), {"ignoreNullFields": "false"}).alias("line"))
    fixed = _fixed(nodes.sparkSession, {0: '{"nodes": [', 2: '], "edges": [', 4: '], "metadata":', 6: "}"})
    return fixed.unionByName(items(1, nodes, ["id", "url"])).unionByName(items(3, edges, ["source", "target", "type"])).unionByName(about)


def write_graph(lines: DataFrame, path: str) -> str:
    """Text files that join in order to one document; an order of ranges, no task holds all."""
    return write_lines(lines, ["section", "position"], path)


def tree_html(lines: list[str], title: str = "Site tree") -> str:
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><pre>{html.escape(chr(10).join(lines))}</pre></body></html>'


def archive(files: list[tuple[str, str]], compress: bool = False) -> tuple[str, bytes]:
    """(name, bytes) of generated files: one as it is or gzipped, several zipped."""
    if len(files) > 1:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in files:
                z.writestr(name, content)
        return "sitemaps.zip", out.getvalue()
    name, content = files[0]
    return (f"{name}.gz", gzip.compress(content.encode(), mtime=0)) if compress else (name, content.encode())
