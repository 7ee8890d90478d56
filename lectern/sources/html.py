"""Course data from HTML pages. Pages become rows by mapInArrow; each page's parse is a small helper on the standard parser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element of the first kind ends when one of the second begins.
CLOSES = {"li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "p": {"p", "div", "table", "ul", "ol", "h1", "h2", "h3"}, "option": {"option"}}


class Node:
    """An element. Elements stand in one list in the order in which they begin, so those inside one are the run after it."""

    def __init__(self, tag: str, attrs: dict, nodes: list[Node]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.nodes, self.at, self.end = nodes, len(nodes), None
        nodes.append(self)

    def all(self, tag: str | None = None, cls: str | None = None, id: str | None = None) -> list[Node]:
        return [
            n
            for n in self.nodes[self.at + 1 : self.end]
            if (tag is None or n.tag == tag) and (cls is None or cls in (n.attrs.get("class") or "").split()) and (id is None or n.attrs.get("id") == id)
        ]

    def first(self, tag: str | None = None, cls: str | None = None, id: str | None = None) -> Node | None:
        return next(iter(self.all(tag, cls, id)), None)

    def text(self) -> str:
        parts = [c.text() if isinstance(c, Node) else c for c in self.children if not (isinstance(c, Node) and c.tag in ("script", "style"))]
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.root = Node("", {}, self.nodes)
        self.open = [self.root]

    def ended(self, node: Node) -> None:
        node.end = len(self.nodes)

    def shut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.ended(self.open.pop())

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and tag in CLOSES.get(self.open[-1].tag, ()):
            self.shut(len(self.open) - 1)
        node = Node(tag, dict(attrs), self.nodes)
        self.open[-1].children.append(node)
        if tag in VOID:
            node.end = len(self.nodes)
        else:
            self.open.append(node)
        return node

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at:
            self.shut(at)

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def read(self, html: str | None) -> Node:
        self.feed(html or "")
        self.close()
        self.shut(1)
        return self.root


def tree(html: str | None) -> Node:
    return _Tree().read(html)


def _spread(pages: DataFrame) -> DataFrame:
    """Pages dealt to four tasks a core: parsing takes far longer than reading, so the few tasks of a small file or of a grouping would last long."""
    return pages.select("url", "html").repartition(4 * pages.sparkSession.sparkContext.defaultParallelism, "url", "html")


def semester_of(title: str) -> tuple[int, int]:
    """(year, semester) of a heading such as "2. Year Fall Semester": year 1 where it names none, semester 1 where it names no season."""
    low = title.lower()
    m = re.search(r"(\d+)\.?\s*year", low)
    year = int(m[1]) if m else 1
    season = 1 if "fall" in low else 2 if "spring" in low else None
    return year, 1 if season is None else (year - 1) * 2 + season


#: Places of name, local credits and ects by the number of cells of a row; rows of more cells are read as those of seven.
LAYOUTS = {7: (2, 5, 6), 6: (1, 4, 5), 5: (1, 3, 4)}
NO_CODES, NO_TITLES = ("code", "kod", "total", "toplam"), ("course name", "ders adı")


def _number(text: str) -> float | None:
    return float(text) if text.replace(".", "", 1).isdigit() else None


CURRICULUM = "url string, pos int, course_code string, course_title string, semester int, course_type string, local_credits double, ects double, href string"


def _course(tr: Node, base: str) -> tuple | None:
    """(code, title, local credits, ects, address) of a row, None if it is no course's."""
    cells = tr.all("td")
    if len(cells) < 5 or tr.first("td", cls="title") or "head" in (tr.attrs.get("class") or "").split() or tr.text().lower().startswith("total"):
        return None
    texts = [c.text() for c in cells]
    link = cells[0].first("a")
    code = re.sub(r"\s+", " ", link.text() if link else texts[0]).strip()
    name_at, credits_at, ects_at = LAYOUTS[min(len(cells), 7)]
    name = texts[name_at]
    if not code or code.lower() in NO_CODES or code.startswith("POOL") or not name or name.lower() in NO_TITLES:
        return None
    href = urljoin(base, link.attrs["href"]) if link and link.attrs.get("href") else None
    return code, name, _number(texts[credits_at]), _number(texts[ects_at]), href


class _Table:
    def __init__(self, node: Node, main: bool):
        self.node, self.main, self.title, self.heading, self.courses = node, main, None, None, {}


class _Curriculum(_Tree):
    """Reads courses row by row and lets go of each row that is in no other cell, so that what is held of a page is its courses, each code of a table once."""

    def __init__(self, base: str):
        super().__init__()
        self.base, self.tables = base, []

    def handle_starttag(self, tag, attrs):
        node = super().handle_starttag(tag, attrs)
        kinds = (node.attrs.get("class") or "").split()
        if tag == "table" and ("curr" in kinds or "table-bordered" in kinds):
            self.tables.append(_Table(node, "curr" in kinds))
        elif tag == "td" and "title" in kinds:
            for t in self.tables:
                if t.title is None and t.node in self.open:
                    t.title = node
        return node

    def ended(self, node):
        super().ended(node)
        if node.tag != "tr" or any(n.tag == "tr" for n in self.open):
            return
        for tr in [node, *node.all("tr")]:
            around = [t for t in self.tables if t.node.at < tr.at and (t.node.end is None or tr.at < t.node.end)]
            found = _course(tr, self.base) if around else None
            for t in around:
                if found:
                    t.courses.setdefault(found[0], found)
        if not any(n.tag in ("td", "th") for n in self.open) and not any(t.node.at > node.at for t in self.tables):
            for t in self.tables:
                if t.title is not None and t.title.at > node.at:
                    t.heading = t.title.text()
            del self.nodes[node.at :]
            self.open[-1].children.remove(node)


def curriculum_rows(html: str | None, base: str = "") -> list[tuple]:
    """(pos, code, title, semester, type, local credits, ects, address) of the courses of a curriculum page, each code once."""
    page = _Curriculum(base)
    page.read(html)
    tables = [t for t in page.tables if t.main] or page.tables
    rows, seen = [], set()
    for t in tables:
        elective = "elective" in (t.node.attrs.get("class") or "").lower()
        _, semester = semester_of(t.heading if t.heading is not None else t.title.text() if t.title else "")
        for code, name, credits, ects, href in t.courses.values():
            if code in seen:
                continue
            seen.add(code)
            kind = "technical_elective" if elective or code.startswith("ELEC") else "non_technical_elective" if code.startswith(("TMD", "NTE")) else "mandatory"
            rows.append((len(rows), code, name, semester if kind == "mandatory" else None, kind, credits, ects, href))
    return rows


def _parsed(pages: DataFrame, parse: Callable, schema: str) -> DataFrame:
    """The rows of parse(html, url) for each page. A page at a time is text and tree in Python, its rows leave as they come."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for url, html in zip(batch.column("url"), batch.column("html"), strict=True):
                rows += parse(html.as_py(), url.as_py())
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return _spread(pages).mapInArrow(run, schema)


def parse_curricula(pages: DataFrame) -> DataFrame:
    """One row per course of each curriculum page (url, html)."""
    return _parsed(pages, lambda html, url: [(url, *r) for r in curriculum_rows(html, url or "")], CURRICULUM)


DETAIL = (
    "url string, course_code string, course_title string, prerequisites string, local_credits double, ects double, fields map<string,string>, "
    "learning_outcomes array<string>, weekly_topics array<string>, assessment string"
)


def course_detail(html: str | None, url: str | None) -> tuple:
    """The parts of a course page; what is missing is null."""
    root = tree(html)
    text = lambda n: (n.text() or None) if n else None
    code = parse_qs(urlparse(url or "").query).get("course_code", [None])[0]
    fields, credits, ects = {}, None, None
    for tr in root.all("tr"):
        cells = [c.text() for c in tr.all() if c.tag in ("td", "th")]
        if len(cells) == 2 and cells[0]:
            fields[cells[0].rstrip(":").lower()] = cells[1]
    transposed = root.first("table", cls="transpose")
    if transposed:
        rows = [[c.text() for c in tr.all() if c.tag in ("td", "th")] for tr in transposed.all("tr")]
        for head, values in zip(rows, rows[1:], strict=False):
            for h, v in zip(head, values, strict=False):
                if "ects" in h.lower():
                    ects = _number(v)
                elif "credit" in h.lower():
                    credits = _number(v)
    outcomes = root.first(id="outcome")
    weeks = root.first(id="weeks")
    topics = []
    for tr in weeks.all("tr") if weeks else []:
        cells = [c.text() for c in tr.all("td")]
        if len(cells) >= 2 and cells[0].isdigit():
            topics.append(f"Week {cells[0]}: {cells[1]}")
    assessment = None
    for name in ("evaluation_table1", "evaluation_table2"):
        found = root.first(id=name)
        lines = []
        for tr in found.all("tr") if found else []:
            cells = [c.text() for c in tr.all("td")]
            if len(cells) >= 3 and cells[2] not in ("", "-"):
                lines.append(f"{cells[0]}: {cells[2]}%")
        if lines:
            assessment = "; ".join(lines)
            break
    items = [li.text() for li in outcomes.all("li")] if outcomes else []
    return url, code, text(root.first(id="course_name")), text(root.first(id="pre_requisites")), credits, ects, fields, [x for x in items if x] or None, topics or None, assessment


def parse_details(pages: DataFrame) -> DataFrame:
    """One row per course page (url, html)."""
    return _parsed(pages, lambda html, url: [course_detail(html, url)], DETAIL)


def enrich(courses: DataFrame, details: DataFrame) -> DataFrame:
    """Courses with what their pages add: a page's value where it has one, else the curriculum's."""
    d = details.select(F.col("url").alias("_href"), *(F.col(c).alias(f"_{c}") for c in ("course_title", "prerequisites", "local_credits", "ects", "learning_outcomes", "weekly_topics", "assessment")))
    joined = courses.join(d, courses["href"] == F.col("_href"), "left")
    both = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("course_title", "local_credits", "ects")}
    alone = {c: F.col(f"_{c}") for c in ("prerequisites", "learning_outcomes", "weekly_topics", "assessment")}
    return joined.withColumns(both | alone).drop(*[c for c in joined.columns if c.startswith("_")])


def carry_headers(rows: DataFrame, page: str = "url", order: str = "row", header: str = "semester_header") -> DataFrame:
    """Each row of a table under the last heading before it."""
    from pyspark.sql import Window

    w = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("under", F.last(header, ignorenulls=True).over(w))


def page_links(html: Column) -> Column:
    """Addresses of links as they stand between quotes of either kind, in order, each once."""
    quoted = F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*(\"[^\"]*\"|'[^']*')"), F.lit(1))
    return F.array_distinct(F.transform(quoted, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)))


def _without_dots(url: Column) -> Column:
    """An address whose path has no steps "." and "..", however many there were; steps above the root go."""
    head = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(url, "^[^?#]*([?#].*)?$", 1)
    steps = F.split(path, "/", -1)
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    folder = F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise("")
    return F.when((head != "") & path.rlike("/\\.{1,2}(/|$)"), F.concat(head, F.array_join(kept, "/"), folder, tail)).otherwise(url)


def absolute_links(html: Column, base: Column) -> Column:
    """page_links() resolved against the page's address, each once: with a scheme, from //, from the root, or from the page's folder."""
    origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(origin, F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", "")))
    bare = F.regexp_replace(base, "#.*$", "")

    def resolved(link: Column) -> Column:
        return (
            F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("/"), _without_dots(F.concat(origin, link)))
            .when(link.startswith("#"), F.concat(bare, link))
            .when(link.startswith("?"), F.concat(origin, path, link))
            .when(link == "", base)
            .otherwise(_without_dots(F.concat(folder, link)))
        )

    return F.array_distinct(F.transform(F.filter(page_links(html), lambda x: x != ""), resolved))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, with single spaces."""
    bare = F.regexp_replace(html, "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), "[ \\t\\r\\n\\f]+", " "))


def course_url(base: str, code: Column, spaces: str = "+") -> Column:
    """The address of a course page; spaces of the code become `spaces` ("+", "" or "%20")."""
    return F.concat(F.lit(base), F.replace(F.url_encode(code), F.lit("+"), F.lit(spaces)))
