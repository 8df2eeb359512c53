"""Column functions on text: personal data, input threats, prices, ratings, availability, actions. All built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import FIELD_ALIASES, PAGE_TYPE

# Patterns of personal data, by type (ASCII digits and word boundaries).
PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
}
# Patterns of input threats.
THREATS = {
    "script_injection": r"(?i)<script[\s>]",
    "sql_injection": r"(?i)(\b(union|select|insert|update|delete|drop|alter|exec)\b.*\b(from|into|table|where)\b)|(--)|(;.*\b(drop|delete|update)\b)",
    "path_traversal": r"\.\./|\.\.\\",
    "event_handler": r"(?i)\bon\w+\s*=",
}
# Words for ratings.
RATING_WORDS = {
    1.0: ("excellent", "outstanding", "perfect", "amazing"), 0.9: ("very good", "great"), 0.8: ("good",), 0.7: ("above average",),
    0.6: ("average", "okay", "ok", "fair"), 0.4: ("below average", "mediocre"), 0.3: ("poor", "bad"), 0.2: ("very poor", "very bad"),
    0.1: ("terrible", "awful", "horrible"),
}
# Words for availability.
OUT_OF_STOCK = ("outofstock", "out_of_stock", "out of stock", "sold out", "soldout", "unavailable", "discontinued")
IN_STOCK = ("instock", "in_stock", "in stock", "available")
SOON = ("preorder", "pre_order", "pre-order", "backorder", "limited")
# Action labels and their (category, action) codes, in order of precedence.
ACTION_LABELS = (
    (("add to cart", "add to bag", "buy now"), (2, 0)), (("remove+cart",), (2, 1)), (("checkout", "check out"), (2, 3)),
    (("wishlist", "save for later"), (2, 5)), (("apply+coupon",), (2, 4)), (("submit", "@submit"), (3, 5)), (("search", "@search"), (1, 0)),
    (("filter", "sort"), (1, 1)), (("log in", "login", "sign in"), (4, 0)), (("sign up", "register"), (4, 2)), (("log out", "logout"), (4, 1)),
    (("play",), (5, 0)), (("download",), (5, 3)), (("share",), (6, 0)), (("like", "upvote"), (6, 1)), (("comment",), (6, 2)),
    (("@a", "@link"), (0, 0)),
)
# Class and id words that tell a page type.
PAGE_WORDS = {
    "product_detail": "product-page product-detail pdp product_detail product-show item-page",
    "article": "article-page blog-post news-article article_page story-page post-page",
    "search_results": "search-results search-page serp search_results results-page",
    "home": "homepage home-page landing-page home_page front-page index-page",
    "cart": "cart-page shopping-cart basket cart_page mini-cart",
    "checkout": "checkout-page checkout-flow checkout_page payment-page",
    "login": "login-page sign-in signin login_page auth-page",
    "account": "account-page my-account profile-page account_page dashboard",
    "product_listing": "category-page product-listing plp product_listing collection-page browse-page",
    "faq": "faq-page help-page faq_page help-center",
    "contact_page": "contact-page contact-us contact_page",
    "about_page": "about-page about-us about_page",
    "documentation": "docs-page documentation api-docs docs_page reference-page",
    "forum": "forum-page community discussion forum_page thread-page",
    "pricing_page": "pricing-page plans-page pricing_page subscription-page",
    "legal": "legal-page terms-page privacy-policy legal_page tos-page",
    "error_page": "error-page not-found 404-page error_page",
    "media_page": "media-page gallery video-page media_page watch-page",
}
# Currency signs.
CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}


#: The patterns as they are sought: an address can only start where a run of name characters starts, or where the match before ended, so that
#: a long run is read once and not from each of its characters.
SOUGHT = PII | {"email": PII["email"].replace("[a-zA-Z0-9._%+-]+@", r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@")}


def _may_have(text: Column, kind: str) -> Column:
    """A cheap necessary condition: addresses have an at sign, the numbers four digits in a row."""
    return text.contains("@") if kind == "email" else text.rlike(r"\d\d\d\d")


def pii_matches(text: Column) -> Column:
    """Array of (type, match) of all personal data in a text, by type."""
    def of(kind: str, pattern: str) -> Column:
        found = F.when(_may_have(text, kind), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("type"), m.alias("match")))

    return F.concat(*[of(k, p) for k, p in SOUGHT.items()])


def pii_spans(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, type, start, end) of every occurrence, in character offsets: an occurrence's place is the length of what the
    split by its pattern leaves before it, so no Python runs."""
    out = None
    for kind, pattern in SOUGHT.items():
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        between = F.split(F.col(text), pattern, -1)
        each = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, s: a + F.length(s)).alias("gaps"), F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, s: a + F.length(s)).alias("before")))  # noqa: B023
        part = df.where(_may_have(F.col(text), kind) & F.col(text).rlike(pattern)).select(*key, F.explode(each).alias("x")).select(*key, F.lit(kind).alias("type"), (F.col("x.gaps") + F.col("x.before")).alias("start"), (F.col("x.gaps") + F.col("x.before") + F.length("x.m")).alias("end"))
        out = part if out is None else out.unionByName(part)
    return out


def has_pii(text: Column) -> Column:
    found = F.lit(False)
    for kind, p in SOUGHT.items():
        found = found | (_may_have(text, kind) & text.rlike(p))
    return found


def threats(text: Column) -> Column:
    """Array of the names of the threats in a value."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in THREATS.items()]))


def is_safe(text: Column) -> Column:
    return F.size(threats(text)) == 0


def sanitized(text: Column) -> Column:
    for k in ("script_injection", "event_handler", "path_traversal"):
        text = F.regexp_replace(text, THREATS[k], "")
    return text


def price_low(text: Column) -> Column:
    """A price text's number; the low end of a range; thousands separators dropped."""
    kept = F.trim(F.regexp_replace(text, r"[^0-9.,\- ]", ""))
    left = F.regexp_replace(F.trim(F.regexp_extract(kept, r"^([^-]*)-", 1)), ",", "")
    first = F.regexp_extract(F.regexp_replace(kept, ",", ""), r"^([0-9.]*)", 1)
    number = lambda c: F.when(c.rlike(r"^(\d+\.?\d*|\.\d+)$"), c.try_cast("double"))
    return F.coalesce(number(left), number(first))


def price_either(text: Column) -> Column:
    """A positive price with the last of comma and point as its decimal mark; a lone comma is one before up to two digits."""
    kept = F.regexp_replace(text, r"[^0-9.,]", "")
    comma, point = kept.contains(","), kept.contains(".")
    last = F.regexp_extract(kept, r"[.,](?=[^.,]*$)", 0)
    plain = (
        F.when(comma & point & (last == ","), F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & point, F.replace(kept, F.lit(","), F.lit("")))
        .when(comma & kept.rlike(r",\d{0,2}$"), F.replace(kept, F.lit(","), F.lit(".")))
        .when(comma, F.replace(kept, F.lit(","), F.lit("")))
        .otherwise(kept)
    )
    value = F.when(plain.rlike(r"^(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))
    return F.when(value > 0, value)


def number_in(text: Column) -> Column:
    kept = F.regexp_replace(text, r"[^0-9.]", "")
    return F.when(kept.rlike(r"^(\d+\.?\d*|\.\d+)$"), kept.try_cast("double"))


def rating_scale(value: Column) -> Column:
    return F.when((value > 5) & (value <= 10), 10.0).when((value > 10) & (value <= 100), 100.0).otherwise(5.0)


def rating_of(text: Column) -> Column:
    """A rating text as 0..1: per cent, words, or a number on the scale it fits; 0 if unknown."""
    low = F.lower(F.trim(text))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    numeric = r"^-?(\d+\.?\d*|\.\d+)$"
    share = F.trim(F.regexp_replace(low, "%+$", ""))
    out = F.when(low.endswith("%") & share.rlike(numeric), clamp(share.try_cast("double") / 100))
    for value, words in RATING_WORDS.items():
        out = out.when(low.isin(list(words)), F.lit(value))
    number = low.try_cast("double")
    scaled = F.when(number <= 5, number / 5).when(number <= 10, number / 10).otherwise(number / 100)
    return out.when(low.rlike(numeric), clamp(scaled)).otherwise(0.0)


def currency_in(text: Column) -> Column:
    """ISO code of the first currency sign."""
    sign = F.regexp_extract(text, "[" + "".join(CURRENCY) + "]", 0)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CURRENCY.items() for x in kv]), sign)


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def availability_of(text: Column) -> Column:
    """1 in stock, 0 out of stock, 0.5 soon, null unknown. Out of stock is looked for first ("unavailable" contains "available")."""
    low = F.lower(text)
    return F.when(_any(low, OUT_OF_STOCK), 0.0).when(_any(low, IN_STOCK), 1.0).when(_any(low, SOON), 0.5)


def action_code(label: Column, element: Column) -> Column:
    """(category, action) of a button or link label; ``@x`` stands for an element type, ``a+b`` for both words."""
    low, out = F.lower(F.coalesce(label, F.lit(""))), None
    for words, (category, action) in ACTION_LABELS:
        hit = F.lit(False)
        for w in words:
            if w.startswith("@"):
                hit = hit | (F.coalesce(element, F.lit("")) == w[1:])
            else:
                both = F.lit(True)
                for part in w.split("+"):
                    both = both & low.contains(part)
                hit = hit | both
        code = F.struct(F.lit(category).alias("category"), F.lit(action).alias("action"))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(F.struct(F.lit(0).alias("category"), F.lit(1).alias("action")))


def page_type_in(classes: Column) -> Column:
    """Page type code told by class and id words, first type in order; null if none."""
    low, out = F.lower(classes), None
    for name, words in PAGE_WORDS.items():
        hit = _any(low, words.split())
        out = F.when(hit, F.lit(PAGE_TYPE[name])) if out is None else out.when(hit, F.lit(PAGE_TYPE[name]))
    return out


def canonical_field(name: Column) -> Column:
    pairs = [x for k, names in FIELD_ALIASES.items() for n in names for x in (F.lit(n), F.lit(k))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)(\p{Lu})", "_$1"))


def camel_case(name: Column) -> Column:
    joined = F.replace(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 20))


def plural(name: Column) -> Column:
    return F.when(name.rlike("(s|x|ch|sh)$"), F.concat(name, F.lit("es"))).when(name.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(name, "y$", ""), F.lit("ies"))).otherwise(F.concat(name, F.lit("s")))
