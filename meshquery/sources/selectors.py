"""What packs of CSS selectors tell of pages: price, rating, stock, page type, review count, image, description, forms, actions,
and things arranged by dragging. Every pass is the join of ``dom.select``; the surest and first value of a field wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators.graph import written
from . import dom as tree

# Attributes, item properties and selectors that hold a field's value.
PACK = {
    "price": {
        "attributes": ("data-price", "data-amount", "data-product-price", "data-value", "data-price-value"), "itemprop": "price",
        "selectors": (
            ".price", ".product-price", ".offer-price", ".current-price", "#priceblock_ourprice", "span.a-price-whole", ".price-current", ".sale-price", ".price__current",
            ".price-box .price", ".priceView-customer-price span", ".s-item__price", '[class*="price"] span', ".buying-price", ".Price-amount",
        ),
    },
    "rating": {
        "attributes": ("data-rating", "data-score", "data-stars", "data-average-rating"), "itemprop": "ratingValue",
        "selectors": (".star-rating", ".review-score", ".rating", ".customer-rating", ".review-stars", ".c-ratings", '[class*="rating"] span', ".product-rating"),
    },
    "review_count": {
        "attributes": ("data-review-count", "data-reviews", "data-num-reviews"), "itemprop": "reviewCount",
        "selectors": (".review-count", ".reviews-count", ".num-reviews", '[class*="review"] .count'),
    },
    "image": {
        "attributes": ("data-image", "data-src", "data-lazy", "data-original"), "itemprop": "image",
        "selectors": (".product-image", ".product-photo", ".gallery-image", ".item-image", ".hero-image", "img.primary", '[class*="product"] img', '[class*="gallery"] img', ".thumbnail img"),
    },
    "description": {
        "attributes": ("data-description", "data-content"), "itemprop": "description",
        "selectors": (
            ".product-description", ".item-description", ".description", ".product-details", ".content-body", ".article-body", ".post-content", ".entry-content",
            '[class*="description"]', '[class*="details"] p',
        ),
    },
}
NAVIGATION = ("nav a", ".nav-item a", ".navbar a", ".breadcrumb a", ".menu a", ".sidebar a", '[role="navigation"] a', ".main-menu a", ".header-nav a")
FORMS = ("form[action]", "form[method]", '[role="search"]', ".search-form", ".login-form", ".signup-form", ".contact-form", ".newsletter-form")
BUTTONS = ('button[type="submit"]', 'input[type="submit"]', '[role="button"]', ".btn", ".button", ".cta", '[class*="btn-"]', "a.button")
IN_STOCK_WORDS = ("in-stock", "instock", "available", "add-to-cart-btn", "fulfillment-add-to-cart")
OUT_WORDS = ("out-of-stock", "outofstock", "unavailable", "sold-out", "soldout", "not-available")
STOCK_PHRASES = (
    (0.0, ("out of stock", "sold out", "currently unavailable", "unavailable")), (0.5, ("pre-order", "preorder", "pre order", "limited stock", "limited availability")),
    (1.0, ("in stock", "available")),
)
# Words of labels and their (category, action) codes, first wins.
LABEL_WORDS = (
    (("add to cart", "buy now", "add to bag", "add to basket", "purchase", "order now"), (2, 0)), (("submit", "send", "apply", "confirm", "continue", "proceed"), (4, 0)),
    (("sign in", "log in", "login", "signin"), (4, 1)), (("subscribe", "sign up", "signup", "register", "join", "enroll"), (4, 3)), (("search", "find", "look up", "discover"), (0, 1)),
)
# Words of link addresses and their codes, for pages without buttons and forms, first wins.
HREF_WORDS = ((("login", "signin", "sign-in"), (4, 1)), (("signup", "register", "sign-up", "join"), (4, 0)), (("search",), (1, 0)), (("subscribe",), (3, 0)), (("contact",), (0, 0)), (("cart", "basket"), (2, 1)))
BUTTON_CLASSES = ("btn", "button", "cta", "action", "nav-link", "primary")
# How sure each kind of source is.
SURE = {"attribute": 0.95, "itemprop": 0.95, "label": 0.90, "selector": 0.85, "text": 0.70, "stock_class": 0.90, "stock_text": 0.80, "body_class": 0.90, "main": 0.85, "body_id": 0.80}
# Sites arranged by dragging: how, the request that it sends, and selectors and id attributes of things and places.
DRAG_PLATFORMS = (
    ("trello.com", "card_move", "PUT", "/1/cards/{card_id}", '{"idList":"{target_list}","pos":"{position}"}', "[data-testid='trello-card'], .list-card", "data-card-id", "[data-testid='list'], .list", "data-list-id"),
    ("github.com", "project_card_move", "PATCH", "/projects/columns/cards/{card_id}/moves", '{"position":"{position}","column_id":"{column_id}"}', ".project-card, [data-card-id]", "data-card-id", ".project-column, [data-column-id]", "data-column-id"),
    ("asana.com", "task_move", "PUT", "/api/1.0/tasks/{task_id}", '{"memberships":[{"project":"{project_id}","section":"{section_id}"}]}', ".BoardCardLayout, [data-task-id]", "data-task-id", ".BoardColumnBody, [data-section-id]", "data-section-id"),
    ("notion.so", "block_move", "POST", "/api/v3/saveTransactions", '{"operations":[{"command":"move","id":"{block_id}","path":["content"],"args":{"after":"{after_id}"}}]}', "[data-block-id]", "data-block-id", "[data-block-id]", "data-block-id"),
    ("monday.com", "item_move", "POST", "/api/v2", '{"query":"mutation { move_item_to_group (item_id: {item_id}, group_id: \\"{group_id}\\") { id }}"}', ".pulse-component, [data-pulse-id]", "data-pulse-id", ".board-group, [data-group-id]", "data-group-id"),
    ("jira.atlassian.com", "issue_move", "POST", "/rest/agile/1.0/issue/{issue_key}/transitions", '{"transition":{"id":"{transition_id}"}}', "[data-rbd-draggable-id], .ghx-issue", "data-issue-key", "[data-rbd-droppable-id], .ghx-column", "data-column-id"),
    ("figma.com", "layer_move", "POST", "/fig-wss/", '{"type":"move_layer","node_id":"{node_id}","parent_id":"{parent_id}","index":"{index}"}', "[data-testid='layer-row'], .layer_row", "data-layer-id", "[data-testid='layer-row']", "data-layer-id"),
    ("airtable.com", "row_reorder", "POST", "/v0/{base_id}/{table_name}", '{"records":[{"id":"{record_id}","fields":{"order":"{position}"}}]}', "[data-rowindex], .dataRow", "data-rowindex", "[data-rowindex], .dataRow", "data-rowindex"),
    ("miro.com", "widget_move", "PATCH", "/api/v2/boards/{board_id}/widgets/{widget_id}", '{"x":"{x}","y":"{y}"}', "[data-widget-id]", "data-widget-id", ".board-canvas", ""),
    ("todoist.com", "task_reorder", "POST", "/api/v9/sync", '{"commands":[{"type":"item_reorder","args":{"items":[{"id":"{task_id}","child_order":"{order}"}]}}]}', "[data-item-id]", "data-item-id", "[data-item-id]", "data-item-id"),
    ("clickup.com", "task_move", "PUT", "/api/v2/task/{task_id}", '{"status":"{status}","orderindex":"{index}"}', "[data-task-id], .cu-task-row", "data-task-id", "[data-status-id], .cu-status-column", "data-status-id"),
)
# Drag libraries in the order in which they are looked for: name, mark among the elements, marks in scripts, selectors
# and id attributes of things and places (none: told by the first one's attributes), and how sure the library alone is.
DRAG_LIBRARIES = (
    ("react-beautiful-dnd", "[data-rbd-draggable-id]", ("DragDropContext", "data-rbd-draggable-id"), "[data-rbd-draggable-id]", "data-rbd-draggable-id", "[data-rbd-droppable-id]", "data-rbd-droppable-id", 0.40),
    ("angular-cdk", "[cdkDrag], [cdkdrag]", ("cdkDrag", "CdkDragDrop"), "[cdkDrag], [cdkdrag]", None, "[cdkDropList], [cdkdroplist]", None, 0.35),
    ("jquery-ui", ".ui-sortable", (), ".ui-sortable > *", None, ".ui-sortable", None, 0.30),
    ("sortablejs", ".sortable", ("Sortable.create", "new Sortable"), ".sortable > *", None, ".sortable", None, 0.35),
    ("dnd-kit", None, ("useDraggable", "@dnd-kit"), "[data-dnd-draggable]", "data-dnd-draggable", "[data-dnd-droppable]", "data-dnd-droppable", 0.35),
    ("html5", '[draggable="true"]', (), '[draggable="true"]', None, "[data-drop-zone], [ondrop]", None, 0.20),
)
SCRIPT_ORDER = ("react-beautiful-dnd", "dnd-kit", "sortablejs", "angular-cdk")
API_SURE, ELEMENTS_SURE, PLATFORM_SURE = 0.40, 0.15, 0.95


def rules() -> list[tuple[str, str, list[str], float]]:
    """(field, selector, where the value stands, confidence) in order of precedence within a field."""
    out = []
    for field, p in PACK.items():
        out += [(field, f"[{a}]", [a], SURE["attribute"]) for a in p["attributes"]]
        out.append((field, f'[itemprop="{p["itemprop"]}"]', ["content", "src", "href"] if field == "image" else ["content", "text"], SURE["itemprop"]))
        if field == "rating":
            out.append(("rating", "[aria-label]", ["aria-label"], SURE["label"]))
        out += [(field, s, ["src"] if field == "image" else ["text"], SURE["selector"]) for s in p["selectors"]]
    out += [("availability", '[itemprop="availability"]', ["href", "content", "text"], SURE["itemprop"]), ("availability", "[class]", ["class"], SURE["stock_class"])]
    out.append(("page_type", "body", ["class"], SURE["body_class"]))
    out += [("page_type", s, ["class", "id"], SURE["main"]) for s in ("main", "article", '[role="main"]')]
    return [*out, ("page_type", "body", ["id"], SURE["body_id"])]


def _first(words_of: tuple, low: Column) -> Column:
    """The value of the first list of words one of which is in a text."""
    out = None
    for given in words_of:
        words, value = given if isinstance(given[0], tuple) else (given[1], given[0])
        said = F.struct(F.lit(value[0]).alias("category"), F.lit(value[1]).alias("action")) if isinstance(value, tuple) else F.lit(value)
        hit = text._any(low, words)
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return out


def _number(field: Column, sure: Column, value: Column) -> Column:
    """A field's value as a number, null if it has none."""
    digits = text.number_in(value)
    label, low = sure == SURE["label"], F.lower(value)
    rated = low.contains("star") | low.contains("rating") | low.contains("out of")
    of, most = F.regexp_extract(value, r"([\d.]+)\s*(?:out of|/)\s*([\d.]+)", 1).try_cast("double"), F.regexp_extract(value, r"([\d.]+)\s*(?:out of|/)\s*([\d.]+)", 2).try_cast("double")
    stars = F.regexp_extract(value, r"([\d.]+)\s*(?:star|rating)", 1).try_cast("double")
    by_label = F.when(rated, F.coalesce(F.when(most > 0, of / most), stars / text.rating_scale(stars)))
    stock = F.when(text._any(low, OUT_WORDS), 0.0).when(text._any(low, IN_STOCK_WORDS), 1.0)
    return (
        F.when(field == "price", text.price_either(value))
        .when((field == "rating") & label, by_label)
        .when(field == "rating", digits / text.rating_scale(digits))
        .when(field == "review_count", F.regexp_extract(F.replace(value, F.lit(","), F.lit("")), r"\d+", 0).try_cast("double"))
        .when((field == "availability") & (sure == SURE["stock_class"]), stock)
        .when(field == "availability", text.availability_of(value))
        .when(field == "page_type", text.page_type_in(value).cast("double"))
    )


def body_text(dom: DataFrame) -> DataFrame:
    """(page, said): text of each page's body; of all of it where no body is marked."""
    body = F.get(F.filter("elements", lambda e: e["tag"] == "body"), F.lit(0))
    return dom.select("page", F.when(body.isNull(), F.col("text")).otherwise(F.trim(F.substring(F.col("text"), body["start"] + 1, body["length"]))).alias("said"))


def patterns(dom: DataFrame, *kept: str) -> DataFrame:
    """A row per parsed page: page, kept.., and for each field its value and confidence (price, currency, rating in 0..1,
    availability, page_type, review_count, image, description)."""
    told, by_page = rules(), tree.dealer(dom)
    numbered = dom.sparkSession.createDataFrame([(i, f, take, c) for i, (f, _, take, c) in enumerate(told)], "selector int, field string, take array<string>, confidence double")
    hits = tree.select(tree.elements(dom), [s for _, s, _, _ in told]).select("selector", "page", "pre", "start", "length", "attrs").join(F.broadcast(numbered), "selector")
    plain = hits.where(~F.array_contains("take", "text")).withColumn("said", F.lit(None).cast("string"))
    read = plain.unionByName(tree.with_text(hits.where(F.array_contains("take", "text")), dom).select(plain.columns))
    each = read.select("page", "selector", "pre", "field", "confidence", "said", "attrs", F.posexplode("take").alias("place", "name"))
    given = each.withColumn("value", F.when(F.col("name") == "text", F.col("said")).otherwise(F.try_element_at(F.col("attrs"), F.col("name")))).where("value <> ''")
    body = body_text(dom)
    money = F.nullif(F.regexp_extract("said", r"[$€£¥]\s*[\d,]+\.?\d*", 0), F.lit(""))
    late = F.lit(1 << 20)
    by_text = body.select("page", late.alias("selector"), F.lit(0).alias("pre"), F.lit(0).alias("place"), F.lit("price").alias("field"), F.lit(SURE["text"]).alias("confidence"), money.alias("value"), text.price_either(money).alias("number"))
    stock = body.select("page", late.alias("selector"), F.lit(0).alias("pre"), F.lit(0).alias("place"), F.lit("availability").alias("field"), F.lit(SURE["stock_text"]).alias("confidence"), F.lit(None).cast("string").alias("value"), _first(STOCK_PHRASES, F.lower("said")).alias("number"))
    # saved: the filter below would repeat the long expressions of every number
    numbers = written(given.withColumn("number", _number(F.col("field"), F.col("confidence"), F.col("value"))).select(by_text.columns).unionByName(by_text).unionByName(stock), "numbers")
    good = numbers.where(F.col("number").isNotNull() | F.col("field").isin("image", "description"))
    order = F.struct("selector", "pre", "place")
    best = lambda f: F.min_by(F.struct("value", "number", "confidence"), F.when(F.col("field") == f, order))
    fields = ["price", "rating", "availability", "page_type", "review_count", "image", "description"]
    found = by_page(good).groupBy("page").agg(*[best(f).alias(f"_{f}") for f in fields])
    out = by_page(dom.select("page", *kept)).join(tree.large(found), "page", "left")
    columns = [c for f in fields[:3] for c in (F.col(f"_{f}.number").alias(f), F.col(f"_{f}.confidence").alias(f"{f}_confidence"))]
    columns += [text.currency_in(F.col("_price.value")).alias("currency"), F.col("_page_type.number").cast("int").alias("page_type"), F.col("_page_type.confidence").alias("page_type_confidence")]
    columns += [F.col("_review_count.number").cast("long").alias("review_count"), F.col("_review_count.confidence").alias("review_count_confidence"), F.col("_image.value").alias("image"), F.col("_description.value").alias("description")]
    return out.select("page", *kept, *columns)


def forms(dom: DataFrame, url: str = "url") -> DataFrame:
    """(page, pre, action, method, fields array<struct<name,type>>) of every form; action is resolved against the column ``url``. A field
    belongs to the form that is open at its place: the last one before it whose interval reaches it."""
    found = tree.select(tree.elements(dom), ["form", "input, select, textarea"]).select("selector", "page", "pre", "last", "tag", "attrs")
    own = F.max(F.when(F.col("selector") == 0, F.struct("pre", "last"))).over(W.partitionBy("page").orderBy("pre").rowsBetween(W.unboundedPreceding, W.currentRow))
    name = F.try_element_at(F.col("attrs"), F.lit("name"))
    inside = found.withColumn("form", own).where("selector = 1 AND form.last >= pre").where(name != "")
    field = F.struct(name.alias("name"), F.coalesce(F.try_element_at(F.col("attrs"), F.lit("type")), F.col("tag")).alias("type"))
    fields = inside.groupBy("page", F.col("form.pre").alias("pre")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", field.alias("field")))), lambda x: x["field"]).alias("fields"))
    base = dom.select("page", F.col(url).alias("base"))
    action, method = F.try_element_at(F.col("attrs"), F.lit("action")), F.try_element_at(F.col("attrs"), F.lit("method"))
    all_forms = found.where("selector = 0").join(tree.large(base), "page").select("page", "pre", F.when(F.coalesce(action, F.lit("")) == "", F.col("base")).otherwise(urls.resolve(F.col("base"), action)).alias("action"), F.upper(F.coalesce(method, F.lit("GET"))).alias("method"))
    return all_forms.join(tree.large(fields), ["page", "pre"], "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<struct<name:string,type:string>>")))


def actions(dom: DataFrame) -> DataFrame:
    """(page, pre, label, category, action, confidence): buttons, links that look like buttons, links to action-like addresses on pages that have
    neither buttons nor forms, and one search for pages with a search field (pre -1)."""
    search = 'input[type="search"], input[name="q"], input[name="query"], input[name="search"]'
    pack = ['button, input[type="submit"], input[type="button"]', 'a[class], a[role="button"]', "a[href]", search, "form"]
    hits = tree.select(tree.elements(dom), pack).select("selector", "page", "pre", "start", "length", "attrs")
    at = lambda n: F.try_element_at(F.col("attrs"), F.lit(n))
    said = tree.with_text(hits.where("selector < 3"), dom)
    label = F.when(F.col("selector") == 0, F.coalesce(at("value"), F.col("said"))).otherwise(F.col("said"))
    like_button = text._any(F.lower(F.coalesce(at("class"), F.lit(""))), BUTTON_CLASSES) | F.coalesce(at("role") == "button", F.lit(False))
    nothing = F.struct(F.lit(0).alias("category"), F.lit(0).alias("action"))
    code = F.coalesce(_first(LABEL_WORDS, F.lower(label)), nothing)
    known = said.withColumn("label", label).where("label <> ''")
    buttons = known.where("selector = 0").select("page", "pre", "label", code.alias("code"), F.when((code["category"] != 0) | (code["action"] != 0), 0.90).otherwise(0.70).alias("confidence"))
    styled = known.where((F.col("selector") == 1) & like_button).select("page", "pre", "label", code.alias("code"), F.lit(0.80).alias("confidence"))
    busy = tree.dealer(dom)(buttons.select("page").unionByName(styled.select("page")).unionByName(hits.where("selector = 4").select("page"))).distinct()
    target = _first(HREF_WORDS, F.lower(at("href")))
    linked = known.where("selector = 2").join(tree.large(busy), "page", "left_anti").withColumn("code", target).where("code IS NOT NULL").select("page", "pre", "label", "code", F.lit(0.70).alias("confidence"))
    looked = hits.where("selector = 3").select("page").distinct().select("page", F.lit(-1).alias("pre"), F.lit("Search").alias("label"), F.struct(F.lit(1).alias("category"), F.lit(0).alias("action")).alias("code"), F.lit(0.85).alias("confidence"))
    every = buttons.unionByName(styled).unionByName(linked).unionByName(looked)
    return every.select("page", "pre", "label", "code.category", "code.action", "confidence")


# dragging

HANDLER = (
    r"(?:onDragEnd|handleDrop|onSortEnd|dropHandler|onDragStop)\s*(?:=\s*(?:async\s*)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>|[:=]\s*(?:async\s+)?function\s*\([^)]*\))\s*"
    r"(\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\}?)"
)


def _request(body: Column) -> Column:
    """struct(method, endpoint, body) of the first request of a handler's body: fetch, else axios, else ajax; null without one."""
    part = lambda p, g=1: F.nullif(F.regexp_extract(body, p, g), F.lit(""))
    fetch, axios, ajax = r"fetch\(\s*['\"`]([^'\"`]+)['\"`]\s*(?:,\s*\{[^}]*method\s*:\s*['\"`](\w+)['\"`])?", r"axios\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)['\"`]", r"\$\.ajax\(\s*\{([^}]*)\}"
    block = part(ajax)
    inner = lambda p: F.nullif(F.regexp_extract(block, p, 1), F.lit(""))
    template = F.coalesce(part(r"JSON\.stringify\(\s*(\{[^}]+\})"), part(r"body\s*:\s*(\{[^}]+\})"))
    said = lambda m, e, t: F.struct(F.upper(m).alias("method"), e.alias("endpoint"), t.alias("body"))
    return (
        F.when(part(fetch).isNotNull(), said(F.coalesce(part(fetch, 2), F.lit("POST")), part(fetch), template))
        .when(part(axios, 2).isNotNull(), said(part(axios), part(axios, 2), template))
        .when(inner(r"url\s*:\s*['\"`]([^'\"`]+)['\"`]").isNotNull(), said(F.coalesce(inner(r"type\s*:\s*['\"`](\w+)['\"`]"), F.lit("POST")), inner(r"url\s*:\s*['\"`]([^'\"`]+)['\"`]"), F.lit(None).cast("string")))
    )


#: Where a page tells its address.
TOLD_SITE = ("base[href]", 'link[rel="canonical"]', 'meta[property="og:url"]')


def told_site(dom: DataFrame) -> DataFrame:
    """(page, site): host of the base address, else of the canonical link, else of og:url."""
    pack = [*TOLD_SITE]
    at = lambda n: F.try_element_at(F.col("attrs"), F.lit(n))
    address = F.when(F.col("selector") == 2, at("content")).otherwise(at("href"))
    first = tree.select(tree.elements(dom), pack).groupBy("page", "selector").agg(F.min_by(address, F.col("pre")).alias("address"))
    host = urls.host(F.col("address"))
    return first.withColumn("site", host).where("site <> ''").groupBy("page").agg(F.min_by("site", "selector").alias("site"))


def drag_actions(dom: DataFrame, scripts: DataFrame | None = None, *kept: str) -> DataFrame:
    """A row per page that is arranged by dragging: (page, platform, library, drag_type, thing_selector, thing_id, place_selector, place_id, method,
    endpoint, body, things, places, confidence, kept..). A known site's pack wins (0.95); else the library found first among the elements, then in
    ``scripts`` (page, code) or the page's own, and the request of a drop handler. things and places count what the selectors find. All is told by a
    page's own row, so that no element moves."""
    spark, every = dom.sparkSession, F.col("elements")
    platforms = spark.createDataFrame([*DRAG_PLATFORMS], "platform string, drag_type string, method string, endpoint string, body string, thing_selector string, thing_id string, place_selector string, place_id string")
    libraries = spark.createDataFrame([(n, thing, thing_id, place, place_id, sure) for n, _, _, thing, thing_id, place, place_id, sure in DRAG_LIBRARIES], "library string, lib_thing_selector string, lib_thing_id string, lib_place_selector string, lib_place_id string, base double")
    address = lambda s, name: urls.host(F.try_element_at(F.get(tree.within(every, s), F.lit(0))["attrs"], F.lit(name)))
    some = lambda c: F.when(c != "", c)
    site = F.coalesce(*[some(address(s, "content" if s.startswith("meta") else "href")) for s in TOLD_SITE])
    names = sorted((p[0] for p in DRAG_PLATFORMS), key=len, reverse=True)  # the longest ending counts
    platform = F.coalesce(*[F.when((F.col("site") == n) | F.endswith("site", F.lit(f".{n}")), F.lit(n)) for n in names])
    said = F.transform(tree.within(every, "script"), lambda e: F.trim(F.substring(F.col("text"), e["start"] + 1, e["length"])))
    own = F.when(F.size("said") > 0, F.array_join("said", "\n"))
    pages = dom.select("page", *kept, "elements", site.alias("site"), said.alias("said")).select("page", *kept, "elements", platform.alias("platform"), own.alias("code"))
    if scripts is not None:
        more = scripts.groupBy("page").agg(F.collect_list("code").alias("more"))
        codes = F.array_sort(F.array_compact(F.concat(F.array("code"), F.coalesce("more", F.array().cast("array<string>")))))
        pages = pages.join(tree.large(more), "page", "left").withColumn("code", F.array_join(codes, "\n")).drop("more")
    code = F.when(F.col("code") != "", F.col("code"))
    marked = {name: F.size(tree.within(every, mark)) > 0 for name, mark, *_ in DRAG_LIBRARIES if mark}
    script_marks, by_code = {lib[0]: lib[2] for lib in DRAG_LIBRARIES}, None
    for name in SCRIPT_ORDER:
        hit = text._any(code, script_marks[name])
        by_code = F.when(hit, F.lit(name)) if by_code is None else by_code.when(hit, F.lit(name))
    first = ("react-beautiful-dnd", "angular-cdk", "jquery-ui", "sortablejs")  # scripts are asked before the others
    order = [*[F.when(marked[n], F.lit(n)) for n in first], by_code, *[F.when(c, F.lit(n)) for n, c in marked.items() if n not in first]]
    library = F.when(F.col("platform").isNull(), F.coalesce(*order))
    request = F.when(F.col("library").isNotNull(), F.get(F.filter(F.transform(F.regexp_extract_all(code, F.lit(HANDLER), F.lit(1)), _request), lambda r: r.isNotNull()), F.lit(0)))
    told = pages.withColumn("library", library).where("platform IS NOT NULL OR library IS NOT NULL").withColumn("r", request).drop("code")
    told = told.join(F.broadcast(platforms), "platform", "left").join(F.broadcast(libraries), "library", "left")
    sure = F.col("base") + F.when(F.col("r").isNotNull(), API_SURE).otherwise(0.0) + ELEMENTS_SURE
    by_site = F.col("platform").isNotNull()
    of = lambda c: F.when(by_site, F.col(c)).otherwise(F.col(f"lib_{c}")).alias(c)
    asked = lambda c: F.when(by_site, F.col(c)).otherwise(F.col(f"r.{c}")).alias(c)
    both = told.select("page", *kept, "elements", "platform", "library", "drag_type", *map(asked, ("method", "endpoint", "body")), *map(of, ("thing_selector", "thing_id", "place_selector", "place_id")), F.when(by_site, F.lit(PLATFORM_SURE)).otherwise(F.least(sure, F.lit(1.0))).alias("confidence"))
    is_id = lambda a: F.startswith(a["key"], F.lit("data-")) & F.endswith(a["key"], F.lit("-id"))
    id_name = lambda e: F.coalesce(F.get(F.filter(F.map_entries(e["attrs"]), is_id), F.lit(0))["key"], F.lit("id"))

    def hits(side: str, asked: set[str]) -> Column:
        """(n, id_name) of what a page's selector finds."""
        out = F.when(F.lit(False), F.lit(None))
        for s in sorted(asked):
            ids = F.transform(tree.within(every, s), id_name)
            out = out.when(F.col(f"{side}_selector") == s, ids)
        return out.alias(f"{side}s")

    things, places = ({p[i] for p in DRAG_PLATFORMS} | {lib[j] for lib in DRAG_LIBRARIES} for i, j in ((5, 3), (7, 5)))
    out = both.withColumns({"things": hits("thing", things), "places": hits("place", places)})
    name = lambda p: F.coalesce(f"{p}_id", F.get(f"{p}s", F.lit(0)), F.lit("id")).alias(f"{p}_id")
    count = lambda p: F.size(f"{p}s").cast("long").alias(f"{p}s")
    return out.select("page", "platform", "library", "drag_type", "thing_selector", name("thing"), "place_selector", name("place"), "method", "endpoint", "body", count("thing"), count("place"), "confidence", *kept)
