"""The query language's text: tokens and syntax tree.

    SELECT * | field [AS name], ...  FROM model [JOIN model ON field = field]...
    [WHERE condition] [ACROSS domain, ...] [ORDER BY field [ASC|DESC], ...] [LIMIT n] [ACROSS domain, ...]

Conditions compare a field with a literal (= != < > <= >=), or are ``field [NOT] IN (literal, ...)``, ``field [NOT] BETWEEN a
AND b``, ``field [NOT] LIKE 'pattern'`` (% and _) or ``field IS [NOT] NULL``; they combine with AND, OR, NOT and parentheses; AND binds
tighter than OR. ACROSS may stand before ORDER BY or at the end. Whatever is left over is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class WqlError(ValueError):
    """A query that can't be read; says where."""


TOKEN = re.compile(r"\s*(?:(?P<number>-?\d+(?:\.\d+)?)(?![\w.])|(?P<name>[A-Za-z_](?:[\w-]*\w)?(?:\.[\w-]*\w)*|\d[\w-]*(?:\.[\w-]+)+)|'(?P<text>[^']*)'|(?P<op><=|>=|!=|<>|[=<>(),*])|(?P<bad>\S))")
KEYWORDS = {"select", "from", "join", "on", "where", "and", "or", "not", "across", "order", "by", "asc", "desc", "limit", "as", "true", "false", "in", "between", "like", "is", "null"}


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        kind = m.lastgroup
        if kind == "bad":
            raise WqlError(f"unexpected {m['bad']!r} at {m.start('bad')}" + (" (unterminated string)" if m["bad"] == "'" else ""))
        value = m[kind]
        if kind == "name" and value.lower() in KEYWORDS:
            kind, value = "key", value.lower()
        out.append(Token(kind, value, m.start(m.lastgroup)))
        at = m.end()
    return out


@dataclass(frozen=True)
class Compare:
    name: str
    op: str
    value: object


@dataclass(frozen=True)
class Null:
    name: str


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple


@dataclass(frozen=True)
class Join:
    model: str
    left: str
    right: str


@dataclass
class Query:
    model: str
    fields: list[tuple[str, str | None]] | None = None  # None: all
    joins: list[Join] = field(default_factory=list)
    where: object | None = None
    across: list[str] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None


class Parser:
    def __init__(self, text: str):
        self.all, self.i, self.size = tokens(text), 0, len(text)

    def _look(self, *values: str) -> bool:
        return self.i < len(self.all) and self.all[self.i].kind in ("key", "op") and self.all[self.i].value in values

    def _take(self, *values: str) -> bool:
        if self._look(*values):
            self.i += 1
            return True
        return False

    def _need(self, what: str, *values: str) -> None:
        if not self._take(*values):
            self._fail(what)

    def _fail(self, what: str):
        here = self.all[self.i] if self.i < len(self.all) else None
        raise WqlError(f"expected {what} at {here.at if here else self.size}" + (f", found {here.value!r}" if here else ", found the end"))

    def _get(self, what: str, *kinds: str) -> str:
        if self.i < len(self.all) and self.all[self.i].kind in kinds:
            self.i += 1
            return self.all[self.i - 1].value
        return self._fail(what)

    def _list(self, one) -> list:
        out = [one()]
        while self._take(","):
            out.append(one())
        return out

    def query(self) -> Query:
        self._need("SELECT", "select")
        fields = None if self._take("*") else self._list(self._field)
        self._need("FROM", "from")
        q = Query(self._get("a model", "name"), fields)
        while self._take("join"):
            model = self._get("a model", "name")
            self._need("ON", "on")
            left = self._get("a field", "name")
            self._need("=", "=")
            q.joins.append(Join(model, left, self._get("a field", "name")))
        if self._take("where"):
            q.where = self._either()
        self._across(q)
        if self._take("order"):
            self._need("BY", "by")
            q.order = self._list(self._sort)
        if self._take("limit"):
            number = self._get("a number", "number")
            if not number.isdigit():
                raise WqlError(f"LIMIT takes a whole number, not {number}")
            q.limit = int(number)
        self._across(q)
        if self.i < len(self.all):
            self._fail("the end")
        return q

    def _across(self, q: Query) -> None:
        if not q.across and self._take("across"):
            q.across = self._list(lambda: self._get("a domain", "name", "text"))

    def _field(self) -> tuple[str, str | None]:
        name = self._get("a field", "name")
        return name, self._get("a name", "name") if self._take("as") else None

    def _sort(self) -> tuple[str, bool]:
        name = self._get("a field", "name")
        down = self._take("desc")
        if not down:
            self._take("asc")
        return name, down

    def _either(self):
        parts = [self._both()]
        while self._take("or"):
            parts.append(self._both())
        return parts[0] if len(parts) == 1 else Logic("or", tuple(parts))

    def _both(self):
        parts = [self._one()]
        while self._take("and"):
            parts.append(self._one())
        return parts[0] if len(parts) == 1 else Logic("and", tuple(parts))

    def _one(self):
        if self._take("not"):
            return Logic("not", (self._one(),))
        if self._take("("):
            inner = self._either()
            self._need(")", ")")
            return inner
        name = self._get("a field", "name")
        if self._take("is"):
            found = Logic("not", (Null(name),)) if self._take("not") else Null(name)
            self._need("NULL", "null")
            return found
        turned = self._take("not")
        if self._take("in"):
            self._need("(", "(")
            found = Logic("or", tuple(Compare(name, "=", v) for v in self._list(self._value)))
            self._need(")", ")")
        elif self._take("between"):
            low = self._value()
            self._need("AND", "and")
            found = Logic("and", (Compare(name, ">=", low), Compare(name, "<=", self._value())))
        elif self._take("like"):
            found = Compare(name, "like", self._get("a pattern", "text"))
        elif turned or not self._look("=", "!=", "<>", "<", ">", "<=", ">="):
            self._fail("a comparison")
        else:
            op = self.all[self.i].value.replace("<>", "!=")
            self.i += 1
            found = Compare(name, op, self._value())
        return Logic("not", (found,)) if turned else found

    def _value(self):
        if self._take("true"):
            return 1.0
        if self._take("false"):
            return 0.0
        if self.i < len(self.all) and self.all[self.i].kind == "text":
            return self._get("a value", "text")
        return float(self._get("a value", "number"))


def parse(text: str) -> Query:
    return Parser(text).query()


PSEUDO = (
    (re.compile(r"(?P<base>\w+)_(?P<days>\d+)d_ago\Z"), "ago"),
    (re.compile(r"predicted_(?P<base>\w+)_(?P<days>\d+)d\Z"), "predicted"),
    (re.compile(r"best_historic_(?P<base>\w+)_domain\Z"), "best_domain"),
    (re.compile(r"best_historic_(?P<base>\w+)\Z"), "best"),
    (re.compile(r"(?P<base>\w+)_trend\Z"), "trend"),
)


def temporal(name: str) -> tuple[str, str, int | None] | None:
    """(kind, base field, days) of a temporal pseudo-column."""
    for pattern, kind in PSEUDO:
        if m := pattern.match(name):
            return kind, m["base"], int(m.groupdict()["days"]) if m.groupdict().get("days") else None
    return None
