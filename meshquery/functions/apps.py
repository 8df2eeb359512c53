"""Column functions on web applications: third-party hosts, REST addresses of known sites, canvas apps, spreadsheet cells, tool
matching, hashes, suggestions; and their registration for SQL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text, urls

# Hosts of analytics and script delivery.
THIRD_PARTY = (
    "google-analytics.com googletagmanager.com googlesyndication.com googleadservices.com google.com/recaptcha gstatic.com facebook.net "
    "facebook.com/tr fbcdn.net connect.facebook.net hotjar.com segment.com segment.io cdn.segment.com analytics. cdnjs.cloudflare.com unpkg.com "
    "cdn.jsdelivr.net ajax.googleapis.com stackpath.bootstrapcdn.com maxcdn.bootstrapcdn.com code.jquery.com newrelic.com nr-data.net sentry.io "
    "browser.sentry-cdn.com fullstory.com mixpanel.com heapanalytics.com clarity.ms doubleclick.net quantserve.com scorecardresearch.com "
    "optimizely.com crazyegg.com mouseflow.com tawk.to intercom.io intercomcdn.com crisp.chat drift.com zendesk.com"
).split()
# Words of a tool's name or description by action category.
TOOL_WORDS = {
    1: "search navigate find filter sort", 2: "cart add remove checkout buy purchase wishlist", 3: "submit fill validate form",
    4: "login register logout auth signin signup", 5: "play pause stop media download", 6: "share like comment follow subscribe",
}
# Marks of pages that draw on a canvas.
CANVAS = ("<canvas", "getContext('webgl')", 'getContext("webgl")', "getContext('2d')", 'getContext("2d")', "WebGLRenderingContext")

# Address templates of sites with a public interface.
REST_TEMPLATES = {
    "en.wikipedia.org": "https://en.wikipedia.org/api/rest_v1/page/summary/{title}", "github.com": "https://api.github.com/repos/{owner}/{repo}",
    "reddit.com": "{url}.json", "www.reddit.com": "{url}.json", "www.npmjs.com": "https://registry.npmjs.org/{package}",
    "npmjs.com": "https://registry.npmjs.org/{package}", "pypi.org": "https://pypi.org/pypi/{package}/json", "crates.io": "https://crates.io/api/v1/crates/{crate_name}",
}
# Sites known to talk over web sockets, and sites whose pages are arranged by dragging.
SOCKET_SITES = (
    "slack.com discord.com teams.microsoft.com web.whatsapp.com linear.app firebase.google.com supabase.co notion.so figma.com github.com "
    "reddit.com x.com stripe.com vercel.com gitlab.com bloomberg.com coinmarketcap.com finance.yahoo.com"
).split()
DRAG_SITES = "trello.com github.com asana.com notion.so monday.com jira.atlassian.com figma.com airtable.com miro.com todoist.com clickup.com".split()
# Marks of pages that may offer tools to a model.
TOOL_MARKS = ("modelContext", "webmcp", "model-context", "navigator.ai")


def known_sockets(domain: Column) -> Column:
    """Whether a site is one of SOCKET_SITES: one name is part of the other."""
    return F.exists(F.array(*[F.lit(s) for s in SOCKET_SITES]), lambda s: F.contains(domain, s) | F.contains(s, domain))


def known_drag(domain: Column) -> Column:
    """Whether a site is one of DRAG_SITES: it ends with the name, or is part of it."""
    return F.exists(F.array(*[F.lit(s) for s in DRAG_SITES]), lambda s: F.endswith(domain, s) | F.contains(s, domain))


def known_rest(domain: Column) -> Column:
    """Whether a site has an address template."""
    return domain.isin(list(REST_TEMPLATES))


def known_address(url: Column) -> Column:
    """REST address of a page of a site with a template; null elsewhere."""
    template = F.try_element_at(F.create_map(*[F.lit(x) for kv in REST_TEMPLATES.items() for x in kv]), urls.host(url))
    return F.when(template.isNotNull(), rest_address(url, template))


def offers_tools(html: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in TOOL_MARKS]), lambda m: F.contains(html, m))


def layers(state: Column) -> Column:
    """Array of struct(name, type, visible) from a JSON state's ``layers`` list."""
    return F.from_json(F.get_json_object(state, "$.layers"), "array<struct<name:string,type:string,visible:boolean>>")


def third_party(url: Column) -> Column:
    low = F.lower(url)
    return F.exists(F.array(*[F.lit(h) for h in THIRD_PARTY]), lambda h: F.contains(low, h))


def rest_address(url: Column, template: Column) -> Column:
    """A known site's REST address of a page: {title}, {owner}, {repo}, {package}, {crate_name}, {url} filled in from the path;
    null where the page has no such part."""
    site = urls.site(url)
    parts = F.filter(F.split(urls.path(url), "/"), lambda s: s != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    fill = lambda name, value: F.replace(template, F.lit(name), value)
    return (
        F.when(site.contains("wikipedia.org"), fill("{title}", second))
        .when(site == "github.com", F.replace(fill("{owner}", first), F.lit("{repo}"), second))
        .when(site.contains("npmjs.com") | (site == "pypi.org"), fill("{package}", F.coalesce(second, first)))
        .when(site == "crates.io", fill("{crate_name}", F.coalesce(second, first)))
        .when(site.contains("reddit.com"), fill("{url}", url))
        .otherwise(template)
    )


def canvas_app(html: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in CANVAS]), lambda m: F.contains(html, m))


def canvas_kind(state: Column) -> Column:
    """What an app's JSON state is about: spreadsheet, design, map, whiteboard or unknown."""
    low = F.lower(state)
    has = lambda *names: low.contains(f'"{names[0]}"') if len(names) == 1 else low.contains(f'"{names[0]}"') & low.contains(f'"{names[1]}"')
    return F.when(low.contains("spreadsheet") | has("cells") | has("rows", "columns"), "spreadsheet").when(has("layers") | has("canvas", "frames"), "design").when(has("lat", "lng") | has("latitude"), "map").when(has("whiteboard") | has("board", "shapes"), "whiteboard").otherwise("unknown")


def cell(reference: Column) -> Column:
    """struct(row, col), from 0, of a cell name like ``AB12``; null if it isn't one."""
    name, number = F.upper(F.regexp_extract(reference, r"^([A-Za-z]{1,4})\d+$", 1)), F.regexp_extract(reference, r"^[A-Za-z]{1,4}(\d{1,9})$", 1)
    column = F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)
    return F.when((name != "") & (number != ""), F.struct((number.try_cast("int") - 1).alias("row"), (column - 1).alias("col")))


def grid_cells(state: Column) -> Column:
    """Array of struct(name, value) from a JSON state's ``cells`` object."""
    pairs = F.from_json(F.get_json_object(state, "$.cells"), "map<string,string>")
    return F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))


def fits_category(name: Column, description: Column, category: Column) -> Column:
    """Whether a tool's words fit an action category."""
    words = F.create_map(*[x for k, v in TOOL_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]))])
    said = F.lower(F.concat_ws(" ", name, description))
    return F.coalesce(F.exists(F.try_element_at(words, category), lambda w: F.contains(said, w)), F.lit(False))


def nearest_name(word: Column, names: list[str], most: int = 3) -> Column:
    """The closest of a few names within ``most`` edits; the first on ties."""
    ranked = F.array_sort(F.array(*[F.struct(F.levenshtein(word, F.lit(n)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)]))
    best = F.element_at(ranked, 1)
    return F.when(best["d"] <= most, best["n"])


@F.pandas_udf(T.LongType())
def fnv1a(values: pd.Series) -> pd.Series:
    """64-bit FNV-1a of a text's UTF-8 bytes, as a signed long."""

    def one(v):
        h = 0xCBF29CE484222325
        for b in v.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return pd.Series([None if v is None or v is pd.NA else one(v) for v in values.astype(object)], dtype="Int64")  # never by way of doubles


class PiiMatches:
    """Table function: (type, start, end, match) of the personal data in a text."""

    def eval(self, said: str):
        for kind, pattern in text.PII.items():
            for m in re.finditer(pattern, said or "", re.ASCII):
                yield kind, m.start(), m.end(), m[0]


def register(spark: SparkSession) -> None:
    """Makes ``resolve_url``, ``fnv1a`` and the table function ``pii_matches`` callable from SQL."""
    spark.udf.register("resolve_url", urls.resolve)
    spark.udf.register("fnv1a", fnv1a)
    spark.udtf.register("pii_matches", F.udtf(PiiMatches, returnType="type string, start int, end int, match string"))
