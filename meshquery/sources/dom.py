"""Page elements as a table, and CSS selectors as joins over it.

One pass of the standard library's parser per page numbers elements in document order. An element covers the interval
[pre, last] of numbers, its text is the slice [start, start + length) of the page's text, so neither is stored again for each ancestor.

A pack of selectors is a small table of compounds (``div.a[b]``). Elements are dealt out by what they could be found
by (tag, id, each class, each attribute) and meet compounds by an equi-join on that key; a chain of compounds is followed
one combinator at a time: an ancestor by the running maximum of interval ends in document order (intervals nest, so an earlier
element whose interval reaches this one contains it), parents and siblings by windows over the numbers where both meet. No pair
of elements is ever formed. Supported: tag, ``*``, #id, .class, [a], [a=v], [a~=v], [a|=v], [a^=v], [a$=v], [a*=v], lists, and
the combinators descendant, ``>``, ``+``, ``~``.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import written

ELEMENT = "pre int, last int, parent int, prev int, depth int, tag string, id string, classes array<string>, attrs map<string,string>, start int, length int"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag that ends open elements: which ones, and the elements that bound the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.open: list[dict] = []
        self.counts: dict[str, int] = {}
        self.parts: list[str] = []
        self.raw: list[str] = []
        self.size = 0
        self.top = -1  # last element without a parent

    def _settle(self) -> None:
        """The text since the last tag, white space collapsed, behind one blank."""
        if self.raw:
            said = " ".join("".join(self.raw).split())
            self.raw.clear()
            if said:
                self.parts.append(said if not self.size else " " + said)
                self.size += len(self.parts[-1])

    def _close(self, depth: int) -> None:
        for e in self.open[depth:]:
            e["last"], e["length"] = len(self.elements) - 1, self.size - e["start"]
            self.counts[e["tag"]] -= 1
        del self.open[depth:]

    def _implied(self, tag: str) -> None:
        if tag in _BLOCKS and self.counts.get("p"):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i]["tag"] == "p":
                    self._close(i)
                    break
                if self.open[i]["tag"] in ("button", "td", "th", "caption"):
                    break
        ended, bounds = ENDS.get(tag, ((), ()))
        if any(self.counts.get(t) for t in ended):
            at = None
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i]["tag"] in bounds:
                    break
                if self.open[i]["tag"] in ended:
                    at = i
            if at is not None:
                self._close(at)

    def handle_starttag(self, tag, attrs):
        self._settle()
        self._implied(tag)
        given: dict[str, str] = {}
        for name, value in attrs:
            given.setdefault(name, value or "")
        above = self.open[-1] if self.open else None
        pre = len(self.elements)
        element = {
            "pre": pre, "last": pre, "parent": above["pre"] if above else -1, "prev": above["child"] if above else self.top, "depth": len(self.open), "tag": tag,
            "id": given.get("id"), "classes": given.get("class", "").split(), "attrs": list(given.items()), "start": self.size, "length": 0, "child": -1,
        }
        if above:
            above["child"] = pre
        else:
            self.top = pre
        self.elements.append(element)
        if tag not in VOID:
            self.open.append(element)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._settle()
        if self.counts.get(tag):
            depth = len(self.open) - 1
            while self.open[depth]["tag"] != tag:
                depth -= 1
            self._close(depth)

    def handle_data(self, data):
        self.raw.append(data)


def tree(html: str | None) -> tuple[str, list[dict]]:
    """A page's text and elements, as ELEMENT has them. Anything is a page; what the parser gives up on ends there."""
    t = _Tree()
    try:
        t.feed(html or "")
        t.close()
    except (AssertionError, ValueError):
        pass
    t._settle()
    t._close(0)
    for e in t.elements:
        del e["child"]
    return "".join(t.parts), t.elements


_BARE = re.compile(r"(<(script|style)\b.*?</\2\s*>)|&(?=#?\w+(?![\w;]))", re.IGNORECASE | re.DOTALL)


def closed(html: str | None) -> str | None:
    """A page in which only character references that end in a semicolon are such: other ampersands are themselves."""
    return html and _BARE.sub(lambda m: m[1] or "&amp;", html)


def parsed(pages: DataFrame, *kept: str, bare: bool = True) -> DataFrame:
    """(page long, kept.., text, elements array<ELEMENT>) of pages with a column html; saved, as every selector reads it. ``page``
    numbers the rows. ``bare``: character references without a semicolon count, as in browsers; else only closed ones do, as in XML."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    own = pages.select(F.monotonically_increasing_id().alias("page"), *kept, "html")
    schema = StructType([f for f in own.schema if f.name != "html"] + StructType.fromDDL(f"text string, elements array<struct<{re.sub(r'(\w+) ', r'\1:', ELEMENT)}>>").fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = []
                for row in batch.slice(at, 100).to_pylist():
                    html = row.pop("html")
                    row["text"], row["elements"] = tree(html if bare else closed(html))
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return written(own.mapInArrow(run, schema), "dom")


def elements(dom: DataFrame) -> DataFrame:
    """(page, ELEMENT) of parsed pages."""
    return dom.select("page", F.inline("elements"))


# selectors

_NAME = r"(?:[\w-]|[^\x00-\x7f])+"
_TOKEN = re.compile(
    rf"\s*(?P<list>,)\s*|\s*(?P<comb>[>+~])\s*|(?P<tag>{_NAME}|\*)|\#(?P<id>{_NAME})|\.(?P<class>{_NAME})"
    rf"|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]|(?P<space>\s+)"
)
COMPOUND = (
    "selector int, alt int, part int, parts int, combinator string, following string, hook string, tag string, id string, classes array<string>, tests array<struct<name:string,op:string,value:string>>"
)


def compounds_of(selector: str) -> list[list[dict]]:
    """The alternatives of a selector, each a chain of compounds."""
    alternatives, chain, at, combinator = [], [], 0, None
    one = lambda: {"combinator": combinator or "", "tag": None, "id": None, "classes": [], "tests": []}
    now, text = None, selector.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found or found.end() == at:
            raise ValueError(f"selector {selector!r} at {text[at:]!r}")
        at = found.end()
        got = found.groupdict()
        if got["list"] or got["comb"] or got["space"]:
            if now is None:
                raise ValueError(f"selector {selector!r}: a combinator without a left side")
            chain.append(now)
            now, combinator = None, got["comb"] or " "
            if got["list"]:
                alternatives.append(chain)
                chain, combinator = [], None
            continue
        now = now or one()
        if got["tag"]:
            now["tag"] = None if got["tag"] == "*" else got["tag"].lower()
        elif got["id"]:
            now["id"] = got["id"]
        elif got["class"]:
            now["classes"].append(got["class"])
        else:
            now["tests"].append({"name": got["attr"].lower(), "op": got["op"] or "", "value": next((got[k] for k in ("dq", "sq", "bare") if got[k] is not None), "")})
    if now is None:
        raise ValueError(f"selector {selector!r} ends in a combinator")
    return [*alternatives, [*chain, now]]


def _hook(c: dict) -> str:
    """What an element that fits the compound can be found by, rarest kind first."""
    if c["id"]:
        return f"#{c['id']}"
    if c["classes"]:
        return f".{c['classes'][0]}"
    if c["tests"]:
        return f"[{c['tests'][0]['name']}"
    return c["tag"] or "*"


def pack(spark: SparkSession, selectors: list[str]) -> DataFrame:
    """COMPOUND rows of a pack of selectors; ``selector`` is a selector's place in the list."""
    rows = []
    for number, selector in enumerate(selectors):
        for alt, chain in enumerate(compounds_of(selector)):
            rows += [(number, alt, part, len(chain), c["combinator"], chain[part]["combinator"] if part < len(chain) else "", _hook(c), c["tag"], c["id"], c["classes"], [(t["name"], t["op"], t["value"]) for t in c["tests"]]) for part, c in enumerate(chain, 1)]
    return spark.createDataFrame(rows, COMPOUND)


def _holds(test: Column | dict, attrs: Column | None = None) -> Column:
    value, want, op = F.try_element_at(F.col("attrs") if attrs is None else attrs, test["name"]), test["value"], test["op"]
    some = want != ""
    return F.coalesce(
        F.when(op == "", value.isNotNull()).when(op == "=", value == want).when(op == "*=", some & F.contains(value, want)).when(op == "^=", some & F.startswith(value, want))
        .when(op == "$=", some & F.endswith(value, want)).when(op == "~=", F.array_contains(F.split(value, r"\s+"), want)).otherwise((value == want) | F.startswith(value, F.concat(want, F.lit("-")))),
        F.lit(False),
    )


def large(rows: DataFrame) -> DataFrame:
    """A side of a join by page, which is sorted and never broadcast: tables of pages and hits compress so well that their files look
    small enough to pass through the driver when their rows are not."""
    return rows.hint("merge")


def tasks_for(rows: DataFrame, each: int = 100_000) -> int:
    """A task per ``each`` rows of a saved table. Spark would join shuffled parts by their compressed bytes, and rows of pages compress too well."""
    return max(1, -(-rows.count() // each))


def dealer(dom: DataFrame, each: int = 1000):
    """A function that deals rows by page to a task per ``each`` pages, so that tables dealt by it meet where they lie."""
    tasks = tasks_for(dom, each)
    return lambda rows: rows.repartition(tasks, "page")


def select(elements: DataFrame, selectors: list[str]) -> DataFrame:
    """(selector, page, ELEMENT) of all elements that a selector of the pack finds, each once per selector. Hits of chains and lists are dealt by
    page once; every step is a window there, so that nothing but the columns asked for moves."""
    spark = elements.sparkSession
    hooks = F.array_compact(F.concat(F.array(F.lit("*"), "tag", F.concat(F.lit("#"), "id")), F.transform("classes", lambda c: F.concat(F.lit("."), c)), F.transform(F.map_keys("attrs"), lambda a: F.concat(F.lit("["), a))))
    rules = pack(spark, selectors)
    chains = [chain for s in selectors for chain in compounds_of(s)]
    names = [f.split()[0] for f in ELEMENT.split(", ")]
    rule = F.broadcast(rules.select("hook", F.struct(*[c for c in rules.columns if c != "hook"]).alias("c")))
    asked = F.array(*[F.lit(h) for h in sorted({_hook(c) for chain in chains for c in chain})])
    fits = (F.col("c.tag").isNull() | (F.col("c.tag") == F.col("tag"))) & (F.col("c.id").isNull() | F.coalesce(F.col("c.id") == F.col("id"), F.lit(False))) & (F.size(F.array_except("c.classes", "classes")) == 0) & F.forall("c.tests", lambda t: _holds(t))
    met = elements.withColumn("hook", F.explode(F.array_intersect(hooks, asked))).join(rule, "hook").where(fits)
    hits = met.select("c.selector", "c.alt", "c.part", "c.parts", "c.combinator", "c.following", "page", *names)
    lists = [i for i, s in enumerate(selectors) if len(compounds_of(s)) > 1]
    longest = max((len(c) for c in chains), default=1)
    if longest == 1 and not lists:
        return hits.select("selector", "page", *names)
    hits = written(hits, "hits")
    alone = (F.col("parts") == 1) & ~F.col("selector").isin(lists)
    others = [n for n in names if n not in ("pre", "last", "parent", "prev")]
    last = F.col("part") == F.col("parts")
    rows = hits.where(~alone).select("selector", "alt", "part", "parts", "combinator", "following", "page", "pre", "last", "parent", "prev", *[F.when(last, F.col(n)).alias(n) for n in others])
    rows = rows.repartition(tasks_for(hits), "page").withColumn("ok", F.col("part") == 1)
    group = ["selector", "alt", "page"]
    for part in range(2, longest + 1):
        used = {c[part - 1]["combinator"] for c in chains if len(c) >= part}
        own, left = F.col("part") == part, (F.col("part") == part - 1) & F.col("ok")
        if " " in used:
            reach = F.max(F.when(left, F.col("last"))).over(W.partitionBy(*group).orderBy("pre").rangeBetween(W.unboundedPreceding, -1))
            rows = rows.withColumn("ok", F.col("ok") | F.coalesce(own & (F.col("combinator") == " ") & (reach >= F.col("pre")), F.lit(False)))
        if used - {" "}:
            # where a step's two sides meet: a parent's or neighbour's number, or for ~ the number of the parent of both
            asks = F.when(F.col("combinator") == "+", F.col("prev")).otherwise(F.col("parent"))
            gives = F.when(F.col("following") == "~", F.col("parent")).otherwise(F.col("pre"))
            meet = F.when(own, asks).when(F.col("part") == part - 1, gives)
            first = F.min(F.when(left & (F.col("following") != " "), F.col("pre"))).over(W.partitionBy(*group, "meet"))
            good = own & (F.col("combinator") != " ") & F.when(F.col("combinator") == "~", first < F.col("pre")).otherwise(first.isNotNull())
            rows = rows.withColumn("meet", meet).withColumn("ok", F.col("ok") | F.coalesce(good, F.lit(False))).drop("meet")
    found = rows.where(last & F.col("ok")).select("selector", "page", *names)
    if lists:
        found = found.dropDuplicates(["selector", "page", "pre"])
    return hits.where(alone).select("selector", "page", *names).unionByName(found)


def _fitting(e: Column, compound: dict) -> Column:
    """Whether an element fits a compound."""
    tests = [e["tag"] == compound["tag"]] if compound["tag"] else []
    tests += [e["id"] == compound["id"]] if compound["id"] else []
    tests += [F.array_contains(e["classes"], c) for c in compound["classes"]]
    tests += [_holds({k: F.lit(v) for k, v in t.items()}, e["attrs"]) for t in compound["tests"]]
    out = e.isNotNull()
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def within(elements: Column, selector: str) -> Column:
    """The elements of one page that a selector finds, from its whole array, in document order: no row leaves its place. Chains may step by ``>`` and ``+``, whose
    other side is told by its number; for descendants and ``~`` there is ``select``."""
    chains = compounds_of(selector)
    if any(c["combinator"] not in ("", ">", "+") for chain in chains for c in chain):
        raise ValueError(f"selector {selector!r} needs select")

    def fits(e: Column) -> Column:
        found = F.lit(False)
        for chain in chains:
            at, good = e, None
            for i in range(len(chain) - 1, -1, -1):
                own = _fitting(at, chain[i])
                good = own if good is None else good & own
                if i:
                    at = F.get(elements, at["parent"] if chain[i]["combinator"] == ">" else at["prev"])
            found = found | good
        return found

    return F.filter(elements, fits)


def with_text(found: DataFrame, dom: DataFrame, name: str = "said") -> DataFrame:
    """Adds each element's text, white space collapsed."""
    by_page = dealer(dom)
    return by_page(found).join(large(by_page(dom.select("page", "text"))), "page").withColumn(name, F.trim(F.substring(F.col("text"), F.col("start") + 1, F.col("length")))).drop("text")
