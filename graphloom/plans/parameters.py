"""Query texts with parameters: @name stands for a term, which is written in so that it can only be a term."""

from __future__ import annotations

import datetime
import decimal
import re
from dataclasses import dataclass, field
from typing import Any

from graphloom.plans import algebra as A
from graphloom.plans.algebra import XSD

#: Strings, IRIs and comments, in which nothing is replaced, or a parameter: an @ that doesn't follow a string, as a language would.
TOKEN = re.compile(r'("""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')(@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?|<[^<>"{}|^`\\\s]*>|#[^\n]*|@([A-Za-z_]\w*)', re.S)


def escaped(text: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f'"{text}"'


def term(value: Any) -> str:
    """A Python value or a node as it is written in a query."""
    if isinstance(value, A.Iri):
        if re.search(r'[<>"{}|^`\\\s]', value.value):
            raise ValueError(f"no IRI: {value.value!r}")
        return f"<{value.value}>"
    if isinstance(value, A.Literal):
        if value.lang:
            if not re.fullmatch(r"[A-Za-z]+(-[A-Za-z0-9]+)*", value.lang):
                raise ValueError(f"no language: {value.lang!r}")
            return f"{escaped(value.value)}@{value.lang}"
        return f"{escaped(value.value)}^^{term(A.Iri(value.datatype))}"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return escaped(value)
    kinds = ((int, "integer", str), (float, "double", repr), (decimal.Decimal, "decimal", lambda v: f"{v:f}"), (datetime.datetime, "dateTime", lambda v: v.isoformat()), (datetime.date, "date", lambda v: v.isoformat()))
    for kind, name, text in kinds:
        if isinstance(value, kind):
            out = {"inf": "INF", "-inf": "-INF", "nan": "NaN"}.get(text(value), text(value))
            return f"{escaped(out)}^^<{XSD}{name}>"
    raise TypeError(f"no term: {type(value).__name__}")


@dataclass
class Parameterized:
    """A query or an update with parameters; str() gives the text with all of them filled in."""

    text: str
    values: dict[str, Any] = field(default_factory=dict)

    def set(self, **values: Any) -> Parameterized:
        return Parameterized(self.text, {**self.values, **values})

    def names(self) -> list[str]:
        return list(dict.fromkeys(m[3] for m in TOKEN.finditer(self.text) if m[3]))

    def __str__(self) -> str:
        missing = [n for n in self.names() if n not in self.values]
        if missing:
            raise ValueError(f"no value for {', '.join(missing)}")
        return TOKEN.sub(lambda m: term(self.values[m[3]]) if m[3] else m[0], self.text)
