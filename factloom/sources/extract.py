"""Facts of source files: declarations, uses and imports, by a tolerant structural parser.

All or nothing per file: a source that can't be read as balanced tokens, or one over the limits, gives no facts and one
diagnostic. Extraction runs per row on the executors; each kind of fact is then a table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.sources.lexer import LexError, Token, tokens

RULES = "php-1;typescript-1;facts-2"
MAX_TOKENS = 1_000_000
MAX_USES = 500_000
#: Words that are no uses of declarations. Fixed values.
PHP_WORDS = frozenset("abstract and array as break callable case catch clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield self parent true false null int float string bool void mixed never object iterable class".split())
TS_WORDS = frozenset("abstract any as asserts async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in infer instanceof interface is keyof let module namespace never new null number object of package private protected public readonly require return satisfies set static string super switch symbol this throw true try type typeof undefined unique unknown using var void while with yield bigint".split())
#: A trait is of class kind; only its signature tells it apart.
CLASS_LIKE = {"class": "class", "interface": "interface", "trait": "class", "enum": "enum"}
MODIFIERS = frozenset("public private protected static abstract final readonly async declare export default override var accessor const get set".split())


@dataclass
class Facts:
    symbols: list[dict] = field(default_factory=list)
    uses: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    locals: list[dict] = field(default_factory=list)  # what variables and typed properties can hold
    diagnostics: list[dict] = field(default_factory=list)


class ParseError(ValueError):
    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


class _Reader:
    """One pass over the tokens with a stack of open containers."""

    def __init__(self, language: str, text: str) -> None:
        self.php = language == "php"
        self.raw = text.encode()
        found = tokens(language, text)
        if len(found) > MAX_TOKENS:
            raise ParseError("too many tokens", 0)
        self.docs = {}
        self.t: list[Token] = []
        for tok in found:
            if tok.kind == "doc":
                self.docs[len(self.t)] = tok.text
            else:
                self.t.append(tok)
        self.close = self._pairs()
        self.open = {b: a for a, b in self.close.items()}
        self.block_end, ends = [], [len(self.raw)]  # of the braces around each token
        for k in range(len(self.t)):
            if k in self.open and self.text(k) == "}":
                ends.pop()
            self.block_end.append(ends[-1])
            if k in self.close and self.text(k) == "{":
                ends.append(self.t[self.close[k]].end)
        self.facts = Facts()
        self.namespace = ""

    def _pairs(self) -> dict[int, int]:
        open_, out = [], {}
        for k, tok in enumerate(self.t):
            if tok.kind == "op" and tok.text in ("(", "[", "{", "#["):
                open_.append(k)
            elif tok.kind == "op" and tok.text in (")", "]", "}"):
                if not open_ or {"(": ")", "[": "]", "{": "}", "#[": "]"}[self.t[open_[-1]].text] != tok.text:
                    raise ParseError(f"unbalanced {tok.text}", tok.start)
                out[open_.pop()] = k
        if open_:
            raise ParseError(f"unclosed {self.t[open_[-1]].text}", self.t[open_[-1]].start)
        return out

    def text(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "name"

    def until(self, k: int, end: int, stops: str) -> int:
        """The first of the stop tokens outside brackets."""
        while k < end and self.text(k) not in stops.split():
            k = self.close.get(k, k) + 1
        return k

    def doc_before(self, k: int) -> str | None:
        return self.docs.get(k)

    def declare(self, kind: str, name_at: int, first: int, last: int, parent: dict | None, header_end: int) -> dict:
        name = self.t[name_at].text
        head = (parent["qualified_name"] if parent else self.namespace)
        joint = ("::" if parent else "\\") if self.php else "."
        s = {
            "kind": kind, "name": name, "qualified_name": f"{head}{joint}{name}" if head else name, "parent": parent["qualified_name"] if parent else None, "parent_start": parent["start_byte"] if parent else None,
            "start_byte": self.t[first].start, "end_byte": self.t[last].end, "signature": " ".join(self.raw[self.t[first].start : self.t[max(first, header_end)].end].decode().split()), "doc_comment": self.doc_before(first),
        }
        self.facts.symbols.append(s)
        return s

    def use(self, kind: str, at: int, inside: dict | None, receiver: str | None = None, relation: str | None = None) -> None:
        tok = self.t[at]
        self.facts.uses.append({"ref_kind": kind, "spelling": tok.text, "start_byte": tok.start, "end_byte": tok.end, "container": inside["qualified_name"] if inside else None, "container_start": inside["start_byte"] if inside else None, "receiver": receiver, "relation": relation, "namespace": self.namespace})
        if len(self.facts.uses) > MAX_USES:
            raise ParseError("too many uses", tok.start)

    def receiver(self, k: int) -> str:
        """Source of what stands before the joint at k - 1."""
        joints = ("->", "?->", "::") if self.php else (".", "?.")
        x = k - 2
        while x >= 0:
            while x > 0 and self.text(x) in (")", "]") and x in self.open:
                x = self.open[x]
                if self.is_name(x - 1) or x and self.t[x - 1].kind == "var" or self.text(x - 1) in (")", "]"):
                    x -= 1
            if x > 1 and self.text(x - 1) in joints:
                x -= 2
                continue
            break
        x = max(x, 0)
        return self.raw[self.t[x].start : self.t[k - 2].end].decode()

    def local(self, variable: str, how: str, type_: str | None, at: int, inside: dict | None) -> None:
        """how: param, property, new, or other for all that may give a variable another value."""
        self.facts.locals.append({"container": inside["qualified_name"] if inside else None, "container_start": inside["start_byte"] if inside else None, "variable": variable, "how": how, "type": type_, "start_byte": self.t[at].start, "block_end": self.block_end[at], "namespace": self.namespace})

    def sole_type(self, k: int, end: int) -> str | None:
        """The one class that a PHP type names; none for unions, intersections and built-in types."""
        names = [x for x in range(k, end) if self.is_name(x) and self.text(x).lower() not in MODIFIERS]
        if len(names) != 1 or any(self.text(x) in ("|", "&", "...") for x in range(k, end)) or self.text(names[0]).lower() in PHP_WORDS:
            return None
        return self.text(names[0])

    # declarations

    def block(self, k: int, end: int, owner: dict | None, inside: dict | None) -> None:
        """Statements of a file, namespace or function body."""
        while k < end:
            k = self.statement(k, end, owner, inside)

    def _skip_modifiers(self, k: int, end: int) -> int:
        while k < end and (self.text(k) in MODIFIERS or self.text(k) in ("#[", "@")):
            if self.text(k) == "#[":
                self.expression(k + 1, self.close[k], None)
                k = self.close[k] + 1
            elif self.text(k) == "@":
                self.use("call", k + 1, None) if self.is_name(k + 1) else None
                k += 2
                k = self.close[k] + 1 if self.text(k) == "(" else k
            elif self.text(k) in ("const", "get", "set", "static", "default") and not self.is_name(k + 1) and self.text(k + 1) not in ("{", "[", "*", "#["):
                return k
            else:
                k += 1
        return k

    def statement(self, k: int, end: int, owner: dict | None, inside: dict | None) -> int:
        first, word = k, self.text(k)
        if word == "namespace" and self.php and self.text(k + 1) != "\\":
            named = self.is_name(k + 1)
            self.namespace = self.text(k + 1) if named else ""
            k += 1 + named
            if self.text(k) == "{":
                self.block(k + 1, self.close[k], None, None)
                self.namespace = ""
                return self.close[k] + 1
            return k + 1
        if word == "use" and self.php and owner is None and inside is None:
            return self.php_use(k + 1, end)
        if word == "import" and not self.php and self.text(k + 1) not in ("(", "."):
            return self.ts_import(k, end)
        body = self._skip_modifiers(k, end)
        word = self.text(body)
        if word in ("namespace", "module") and not self.php and (self.is_name(body + 1) or self.t[min(body + 1, len(self.t) - 1)].kind == "string") and self.text(body + 2) in ("{", "."):
            at = self.until(body, end, "{")
            s = self.declare("module", body + 1, first, self.close[at], owner, at - 1)
            self.block(at + 1, self.close[at], s, s)
            return self.close[at] + 1
        if word in CLASS_LIKE and self.is_name(body + 1) and self.text(body - 1) not in ("::", "->", "."):
            return self.class_like(first, body, end, owner)
        if word == "function" and (self.is_name(body + 1) or self.text(body + 1) in ("&", "*")):
            name = body + 1 + (self.text(body + 1) in ("&", "*"))
            if self.is_name(name):
                return self.function(first, name, end, owner if not self.php else None, "function")
        if word == "type" and not self.php and self.is_name(body + 1) and self.text(body + 2) in ("=", "<"):
            stop = self.until(body + 2, end, ";")
            stop = min(stop, end - 1)
            s = self.declare("type_alias", body + 1, first, stop, owner, stop - 1)
            self.types(self.until(body + 2, end, "=") + 1, stop + (self.text(stop) != ";"), s)
            return stop + 1
        if word == "const" and self.php or (not self.php and body > first and self.text(body - 1) == "const" and inside is None) or (not self.php and word in ("let", "var", "const") and inside is None):
            return self.constants(first, body + (word in ("const", "let", "var")), end, owner, inside)
        if self.text(k) == "export" and not self.php and self.text(k + 1) in ("{", "*"):
            return self.ts_export(k, end)
        # an ordinary statement
        stop = self.until(max(body, k), end, "; {")
        if stop < end and self.text(stop) == "{":
            self.expression(max(body, k), stop, inside)
            self.block(stop + 1, self.close[stop], None, inside) if inside is not None or owner is None else None
            return self.close[stop] + 1
        self.expression(max(body, k), stop, inside)
        return max(stop + 1, k + 1)

    def class_like(self, first: int, at: int, end: int, owner: dict | None) -> int:
        open_ = self.until(at, end, "{")
        if open_ >= end:
            raise ParseError(f"{self.text(at)} without a body", self.t[at].start)
        s = self.declare(CLASS_LIKE[self.text(at)], at + 1, first, self.close[open_], None if self.php else owner, open_ - 1)
        k, kind = at + 2, None
        while k < open_:
            if self.text(k) in ("extends", "implements"):
                kind = self.text(k)
            elif self.is_name(k) and self.text(k).lower() not in (PHP_WORDS if self.php else TS_WORDS):
                self.use("type", k, s, relation=kind if self.text(k - 1) not in ("<", "|") else None)
            k += 1
        self.members(open_ + 1, self.close[open_], s, self.text(at) == "enum")
        return self.close[open_] + 1

    def members(self, k: int, end: int, owner: dict, enum: bool) -> None:
        while k < end:
            first = k
            if self.text(k) in (";", ","):
                k += 1
                continue
            if self.php and self.text(k) == "use":
                stop = self.until(k, end, "; {")
                for x in range(k + 1, stop):
                    if self.is_name(x):
                        self.use("unknown", x, owner)
                k = (self.close[stop] if self.text(stop) == "{" else stop) + 1
                continue
            body = self._skip_modifiers(k, end)
            if self.php and self.text(body) == "case" or (not self.php and enum):
                name = body + (1 if self.php else 0)
                stop = min(self.until(name, end, "; ,"), end)
                self.declare("const", name, first, stop - 1, owner, stop - 1)
                self.expression(name + 1, stop, owner)
                k = stop + 1
            elif self.php and self.text(body) == "function":
                name = body + 1 + (self.text(body + 1) == "&")
                k = self.function(first, name, end, owner, "method")
            elif self.php and (self.text(body - 1) == "const" or self.text(body) == "const"):
                k = self.constants(first, body + (self.text(body) == "const"), end, owner, owner)
            elif not self.php:
                k = self.ts_member(first, body, end, owner)
            else:
                stop = min(self.until(body, end, "; {"), end)
                for x in range(body, stop):
                    if self.t[x].kind == "var":
                        self.declare("property", x, first, stop - 1, owner, stop - 1)
                        self.local(self.text(x), "property", self.sole_type(body, x), x, owner)
                        self.expression(x + 1, stop, owner)
                        break
                    if self.is_name(x) and self.text(x).lower() not in PHP_WORDS:
                        self.use("type", x, owner)
                k = (self.close[stop] if stop < end and self.text(stop) == "{" else stop) + 1

    def ts_member(self, first: int, at: int, end: int, owner: dict) -> int:
        if self.text(at) == "{":  # a static block
            self.block(self.close and at + 1, self.close[at], None, owner)
            return self.close[at] + 1
        name = at + (self.text(at) == "*")
        if not (self.is_name(name) or name < end and self.t[name].kind in ("string", "number")):
            stop = min(self.until(at, end, ";"), end)
            self.types(at, stop, owner)
            return stop + 1
        after = name + 1 + (self.text(name + 1) in ("?", "!"))
        if self.text(after) in ("(", "<"):
            return self.function(first, name, end, owner, "method")
        stop = min(self.until(after, end, ";"), end)
        for x in range(after, stop):  # without semicolons a member ends before the next line's name
            if x > after and self.raw[self.t[x - 1].end : self.t[x].start].count(b"\n") and self.is_name(x) and self.text(x - 1) not in ("=", ":", "|", "&", "=>", ",", "(", "+", "?", ".", "{", "["):
                stop = x
                break
        s = self.declare("property", name, first, stop - 1, owner, stop - 1)
        equal = self.until(after, stop, "=")
        self.types(after, equal, s)
        self.expression(equal + 1, stop, s)
        return stop + (self.text(stop) == ";")

    def function(self, first: int, name: int, end: int, owner: dict | None, kind: str) -> int:
        k = self.until(name + 1, end, "(")
        if k >= end:
            raise ParseError("a function without parameters", self.t[name].start)
        close = self.close[k]
        stop = close + 1
        while stop < end and self.text(stop) not in ("{", ";"):
            if self.text(stop) in ("(", "[") or (self.text(stop) == "{" and self.text(stop - 1) == ":"):
                stop = self.close[stop]
            elif not self.php and stop > close + 1 and self.raw[self.t[stop - 1].end : self.t[stop].start].count(b"\n") and self.text(stop - 1) not in ("|", "&", ":", "=>", ","):
                break
            stop += 1
        has_body = stop < end and self.text(stop) == "{"
        if has_body and self.text(stop - 1) == ":":  # an object type, then maybe a body
            stop = self.close[stop] + 1
            has_body = self.text(stop) == "{"
        last = self.close[stop] if has_body else min(stop, end - 1) if self.text(min(stop, end - 1)) == ";" else stop - 1
        s = self.declare(kind, name, first, last, owner, stop - 1)
        self.parameters(k + 1, close, s, owner)
        self.types(close + 1, stop, s)
        if has_body:
            self.block(stop + 1, last, None, s)
        return last + 1

    def parameters(self, k: int, end: int, inside: dict, owner: dict | None) -> None:
        while k < end:
            stop = self.until(k, end, ",")
            equal = self.until(k, stop, "=")
            promoted = any(self.text(x) in ("public", "private", "protected", "readonly") for x in range(k, equal))
            for x in range(k, equal):
                if self.php and self.t[x].kind == "var":
                    self.local(self.text(x), "param", self.sole_type(k, x), x, inside)
                    if promoted and owner:
                        self.declare("property", x, k, equal - 1, owner, equal - 1)
                        self.local(self.text(x), "property", self.sole_type(k, x), x, owner)
            if self.php:
                self.types(k, equal, inside)
            else:
                colon = self.until(k, equal, ":")
                if promoted and owner and self.is_name(colon - 1):
                    self.declare("property", colon - 1, k, equal - 1, owner, equal - 1)
                self.types(colon, equal, inside)
            self.expression(equal + 1, stop, inside)
            k = stop + 1

    def constants(self, first: int, k: int, end: int, owner: dict | None, inside: dict | None) -> int:
        stop = self.until(k, end, ";")
        last = min(stop, end - 1)
        while k < stop:
            comma = self.until(k, stop, ",")
            equal = self.until(k, comma, "=")
            name = next((x for x in range(equal - 1, k - 1, -1) if self.is_name(x)), None) if self.php else (k if self.is_name(k) else None)
            s = inside
            if name is not None:
                arrow = not self.php and (self.text(equal + 1) == "function" or any(self.text(x) == "=>" for x in range(equal, min(comma, equal + 40))))
                s = self.declare("function" if arrow else "const", name, first, last, owner, min(equal, last))
                if not self.php:
                    self.types(name + 1, equal, s)
            self.expression(equal + 1, comma, s)
            k = comma + 1
        return stop + 1

    # uses

    def types(self, k: int, end: int, inside: dict | None) -> None:
        words = PHP_WORDS if self.php else TS_WORDS
        for x in range(k, end):
            if self.is_name(x) and self.text(x).lower() not in words and self.text(x + 1) not in (":", "?:") and self.text(x - 1) not in (".",):
                self.use("type", x, inside)

    def expression(self, k: int, end: int, inside: dict | None) -> None:
        """Uses in code between two tokens; closures belong to what surrounds them."""
        words = PHP_WORDS if self.php else TS_WORDS
        while k < end:
            text, before, after = self.text(k), self.text(k - 1), self.text(k + 1)
            kind = self.t[k].kind
            if self.php and text == "class" and before == "new" or not self.php and text == "class":
                open_ = self.until(k + 1, end, "{")
                if open_ < end:
                    self.expression(k + 1, open_, inside)
                    shell = {"qualified_name": (inside or {"qualified_name": ""})["qualified_name"] or "", "start_byte": (inside or {"start_byte": 0})["start_byte"]}
                    self.block(open_ + 1, self.close[open_], None, inside or shell)
                    k = self.close[open_] + 1
                    continue
            member = before in ("->", "?->", "::") if self.php else before in (".", "?.")
            if kind == "var" and before != "::" and text != "$this":
                if after == "=" and self.text(k + 2) == "new" and self.is_name(k + 3) and self.text(k + 3).lower() not in PHP_WORDS and before in (";", "{", "}"):
                    self.local(text, "new", self.text(k + 3), k, inside)
                elif (after.endswith("=") and after not in ("==", "===", "!=", "!==", "<=", ">=")) or after in ("++", "--") or before in ("&", "as", "=>", "global", "static", "++", "--") or (before in ("(", ",", "[") and after in (")", ",", "]")):
                    self.local(text, "other", None, k, inside)  # assigned, or handed to what may assign it
            if kind == "var" and before == "::":
                self.use("write" if after == "=" else "read", k, inside, self.text(k - 2))
            elif kind == "name" and member:
                receiver = self.receiver(k)
                called = after == "("
                self.use("call" if called else "write" if after == "=" else "read", k, inside, receiver)
            elif kind == "name" and text.lower() not in words and not (not self.php and after == ":" and before in ("{", ",")):
                if before == "new":
                    self.use("type" if self.php else "call", k, inside, relation="new")
                elif after == "(":
                    self.use("call", k, inside)
                elif self.php and (after == "::" or before in ("instanceof", "|") or (self.t[k + 1].kind == "var" if k + 1 < len(self.t) else False)):
                    self.use("type", k, inside)
                elif not self.php and before in (":", "as", "satisfies") or before == "extends":
                    self.use("type", k, inside)
                elif not self.php and after == "=" and before not in ("const", "let", "var"):
                    self.use("write", k, inside)
                elif before not in ("goto", "function", "const", "let", "var") and not (self.php and after == ":"):
                    self.use("read", k, inside)
            k += 1

    # imports

    def php_use(self, k: int, end: int) -> int:
        stop = self.until(k, end, ";")
        kind = self.text(k) if self.text(k) in ("function", "const") else "class"
        k += kind != "class"
        prefix = ""
        while k < stop:
            if self.is_name(k) and self.text(k + 1) == "\\" or self.text(k + 1) == "{":
                prefix = self.text(k).rstrip("\\") + "\\"
                k += 1
            elif self.is_name(k) and self.text(k) != "as":
                target = (prefix + self.text(k)).lstrip("\\")
                alias = self.text(k + 2) if self.text(k + 1) == "as" else target.rsplit("\\", 1)[-1]
                self.facts.imports.append({"kind": kind, "alias": alias, "target": target, "start_byte": self.t[k].start, "end_byte": self.t[k].end, "namespace": self.namespace})
                self.use("import", k, None)
                k += 2 if self.text(k + 1) == "as" else 0
            elif self.text(k) == "{":
                pass
            k += 1
        return stop + 1

    def ts_import(self, k: int, end: int) -> int:
        stop = k + 1
        while stop < end and self.t[stop].kind != "string":
            stop = self.close.get(stop, stop) + 1
        module = self.text(stop)[1:-1]
        x = k + 1
        depth = 0
        while x < stop:
            word = self.text(x)
            depth += (word == "{") - (word == "}")
            if word == "*" and self.text(x + 1) == "as":
                self._ts_import(x + 2, "*", module)
                x += 2
            elif self.is_name(x) and word not in ("from", "type") or word == "type" and depth and self.text(x + 1) in (",", "}", "as"):
                if self.text(x + 1) == "as" and depth:
                    self._ts_import(x + 2, word, module)
                    x += 2
                else:
                    self._ts_import(x, word if depth else "default", module)
            x += 1
        return stop + 1 + (self.text(stop + 1) == ";")

    def _ts_import(self, at: int, name: str, module: str) -> None:
        self.facts.imports.append({"kind": "module", "alias": self.text(at), "target": f"{module}#{name}", "start_byte": self.t[at].start, "end_byte": self.t[at].end, "namespace": ""})
        self.use("import", at, None)

    def ts_export(self, k: int, end: int) -> int:
        stop = min(self.until(k, end, ";"), end)
        if self.text(k + 1) == "{":
            for x in range(k + 2, self.close[k + 1]):
                if self.is_name(x) and self.text(x) not in ("as", "type", "default") and self.text(x - 1) != "as":
                    self.use("read", x, None)
            stop = self.close[k + 1]
        if self.text(stop + 1) == "from":
            stop += 2
        return stop + 1 + (self.text(stop + 1) == ";")


def extract(language: str, source: bytes) -> Facts:
    try:
        text = source.decode()
        reader = _Reader(language, text)
        reader.block(0, len(reader.t), None, None)
        return reader.facts
    except (ParseError, LexError) as e:
        limit = "too many" in str(e)
        return Facts(diagnostics=[{"code": "resource_limit" if limit else "parse_error", "detail": str(e), "start_byte": e.at}])
    except (RecursionError, KeyError, IndexError):
        return Facts(diagnostics=[{"code": "parse_error", "detail": "not understood", "start_byte": 0}])


_SYMBOL = "struct<kind:string,name:string,qualified_name:string,parent:string,parent_start:long,start_byte:long,end_byte:long,signature:string,doc_comment:string,start_line:int,end_line:int>"
_USE = "struct<ref_kind:string,spelling:string,start_byte:long,end_byte:long,container:string,container_start:long,receiver:string,relation:string,namespace:string,line:int,col:int>"
_IMPORT = "struct<kind:string,alias:string,target:string,start_byte:long,end_byte:long,namespace:string>"
_LOCAL = "struct<container:string,container_start:long,variable:string,how:string,type:string,start_byte:long,block_end:long,namespace:string>"
_DIAGNOSTIC = "struct<code:string,detail:string,start_byte:long>"
RAW_SCHEMA = f"file string, language string, symbols array<{_SYMBOL}>, uses array<{_USE}>, imports array<{_IMPORT}>, locals array<{_LOCAL}>, diagnostics array<{_DIAGNOSTIC}>"


def _lines(source: bytes, facts: Facts) -> None:
    """Lines from 1, columns in bytes from 1; a symbol's end line is that of its last byte."""
    import bisect

    starts = [0]
    at = source.find(b"\n")
    while at >= 0:
        starts.append(at + 1)
        at = source.find(b"\n", at + 1)
    for s in facts.symbols:
        s["start_line"] = bisect.bisect_right(starts, s["start_byte"])
        s["end_line"] = bisect.bisect_right(starts, max(s["start_byte"], s["end_byte"] - 1))
    for u in facts.uses:
        u["line"] = bisect.bisect_right(starts, u["start_byte"])
        u["col"] = u["start_byte"] - starts[u["line"] - 1] + 1


def raw_facts(files: DataFrame) -> DataFrame:
    """One row per ok file with its facts as arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, source in zip(batch["path"], batch["language"], batch["source"], strict=True):
                facts = extract(language, bytes(source))
                _lines(bytes(source), facts)
                rows.append((path, language, facts.symbols, facts.uses, facts.imports, facts.locals, facts.diagnostics))
            yield pd.DataFrame(rows, columns=["file", "language", "symbols", "uses", "imports", "locals", "diagnostics"])

    return files.where("parse_status = 'ok'").select("path", "language", "source").mapInPandas(run, RAW_SCHEMA)


def fact_tables(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, uses, imports and diagnostics, with ids, lookup names and containers; parsed rows are kept for all of them."""
    return tables_of(raw_facts(files).persist())


def tables_of(raw: DataFrame) -> dict[str, DataFrame]:
    from factloom.operators.lookup import with_ordinals

    s = with_ordinals(raw.select("file", "language", F.explode("symbols").alias("s")).select("file", "language", "s.*"))
    folded = F.when((F.col("language") == "php") & ~F.col("kind").isin("property", "const"), S.ascii_fold(F.col("name"))).otherwise(F.regexp_replace("name", "^[$]", ""))
    symbols = s.withColumn("id", S.canonical_id(F.col("file"), F.col("qualified_name"), F.col("ordinal"))).withColumn("lookup_name", folded)
    ids = symbols.select("file", F.col("qualified_name").alias("_q"), F.col("start_byte").alias("_s"), F.col("id").alias("_id")).dropDuplicates(["file", "_q", "_s"])
    symbols = symbols.join(ids.withColumnsRenamed({"_q": "parent", "_s": "parent_start", "_id": "parent_id"}), ["file", "parent", "parent_start"], "left").drop("parent", "parent_start")
    u = raw.select("file", "language", F.explode("uses").alias("u")).select("file", "language", "u.*")
    uses = u.join(ids.withColumnsRenamed({"_q": "container", "_s": "container_start", "_id": "containing_symbol"}), ["file", "container", "container_start"], "left").drop("container", "container_start")
    short = F.when(F.col("language") == "php", S.short_name(F.col("spelling"))).otherwise(F.col("spelling"))
    uses = uses.withColumn("lookup_name", F.when((F.col("language") == "php") & F.col("ref_kind").isin("call", "type", "unknown", "import"), S.ascii_fold(short)).otherwise(short))
    uses = uses.withColumn("use_id", F.xxhash64("file", "start_byte", "end_byte", "ref_kind")).dropDuplicates(["file", "start_byte", "end_byte", "ref_kind"])
    explode = lambda name: raw.select("file", "language", F.explode(name).alias("x")).select("file", "language", "x.*")
    local = explode("locals").join(ids.withColumnsRenamed({"_q": "container", "_s": "container_start", "_id": "containing_symbol"}), ["file", "container", "container_start"], "left").drop("container", "container_start")
    return {"symbols": symbols, "uses": uses, "imports": explode("imports"), "locals": local, "diagnostics": explode("diagnostics")}
