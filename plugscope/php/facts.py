"""Facts of a PHP file: one pass over its tokens gives rows for the relational fact base."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from ..config import Config
from ..functions import auth
from .lexer import Source, collapse, strip_comments, unquote

_KEYWORDS = frozenset("if elseif else while for foreach switch return echo print isset unset empty list array function fn new clone include include_once require require_once exit die and or xor match catch use static declare global case default do try finally throw yield instanceof const public private protected abstract final class interface trait extends implements namespace as self parent true false null".split())
_INTERPOLATED = re.compile(r"\{\$this->(\w+)\}|\{\$(\w+)(?:[^}]*)\}|\$\{(\w+)\}|\$this->(\w+)|\$(\w+)")
_DIRECT = re.compile(r"""\$_(?:POST|GET|REQUEST)\s*\[\s*['"]action['"]\s*\]\s*={2,3}\s*['"]([^'"]+)['"]|['"]([^'"]+)['"]\s*={2,3}\s*\$_(?:POST|GET|REQUEST)\s*\[\s*['"]action['"]\s*\]""")
_BOOTSTRAP = re.compile(r"\b(?:ABSPATH|WPINC|WP_UNINSTALL_PLUGIN)\b|function_exists\s*\(\s*['\"](?:add_action|add_filter)['\"]")
_LITERAL = re.compile(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\"""")

_KEY_FOLLOWS = re.compile(r"\s*=>")
_BUILTIN_TYPES = frozenset("array callable bool boolean int integer float double string iterable object mixed void null false true never self static parent".split())

DELEGATES = 5  # instance calls, and as many static ones, that a body's level may be delegated to


@dataclass
class Scope:
    """What names of a file stand for; the last assignment wins."""

    consts: dict[str, str] = field(default_factory=dict)  # NAME and Class::NAME
    lower: dict[str, str] = field(default_factory=dict)  # the same by lower-case names, the first of each
    props: dict[str, str] = field(default_factory=dict)
    assigns: dict[str, tuple[list[int], list[tuple[int, int]]]] = field(default_factory=dict)  # of each variable: offsets, tokens of the values

    def constant(self, name: str, value: str) -> None:
        self.consts[name] = value
        self.lower.setdefault(name.lower(), value)

    def assign(self, name: str, off: int, first: int, last: int) -> None:
        offs, values = self.assigns.setdefault(name, ([], []))
        offs.append(off)
        values.append((first, last))

    def last(self, name: str, before: int, since: int = 0) -> tuple[int, int, int] | None:
        """Offset and tokens of a variable's last assignment in since..before-1."""
        offs, values = self.assigns.get(name, ((), ()))
        k = bisect_left(offs, before) - 1
        return (offs[k], *values[k]) if k >= 0 and offs[k] >= since else None


class Nesting:
    """Innermost span at an offset: a sweep over the spans' ends leaves segments that are found by bisection."""

    def __init__(self, spans: list[dict]):
        self.starts: list[int] = []
        self.held: list[tuple[dict, ...]] = []
        stack: list[dict] = []
        for x in sorted(spans, key=lambda x: (x["off"], -x["end_off"])):
            self._close(stack, x["off"])
            stack.append(x)
            self._add(x["off"], stack)
        self._close(stack, None)

    def _close(self, stack: list[dict], before: int | None) -> None:
        while stack and (before is None or stack[-1]["end_off"] <= before):
            end = stack.pop()["end_off"]
            self._add(end, stack)

    def _add(self, off: int, stack: list[dict]) -> None:
        if self.starts and self.starts[-1] == off:
            self.held[-1] = tuple(stack)
        else:
            self.starts.append(off)
            self.held.append(tuple(stack))

    def at(self, off: int) -> tuple[dict, ...]:
        """Spans around an offset, the outermost first."""
        k = bisect_right(self.starts, off) - 1
        return self.held[k] if k >= 0 else ()


class File:
    """Facts of one file. Offsets are characters of the text with comments blanked."""

    def __init__(self, text: str, config: Config | None = None):
        self.config = config or Config()
        self.text = strip_comments(text[1:] if text.startswith("﻿") else text)
        self.src = Source(self.text)
        self.tokens = self.src.tokens
        self.checks = auth.Checks(self.src)
        self.scope = Scope()
        self.classes: list[dict] = []
        self.functions: list[dict] = []
        self.calls: list[dict] = []
        self.symbols: list[dict] = []
        self.foreachs: list[dict] = []
        self.includes: list[dict] = []
        self.namespace = ""
        self.uses: dict[str, str] = {}
        self._open: list[dict] = []  # classes and functions around the place that _declarations has come to
        self._inside: tuple[Nesting, Nesting] | None = None
        self._values: dict[str, list[dict]] = {}  # properties by name
        self.made: dict[tuple[str, str], str] = {}  # classes of (class, property)
        self._declarations()
        self._inside = Nesting(self.classes), Nesting(self.functions)
        self._assignments()
        self._loops = Nesting(self.foreachs)
        self._calls()
        self._direct_actions()

    def _is(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text.lower() == text

    def _kind(self, i: int, kind: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == kind

    def _fqn(self, name: str) -> str:
        if name.startswith("\\"):
            return name[1:]
        head, _, tail = name.partition("\\")
        if head.lower() in self.uses:
            return self.uses[head.lower()] + ("\\" + tail if tail else "")
        return f"{self.namespace}\\{name}" if self.namespace else name

    def _declarations(self) -> None:
        for i, t in enumerate(self.tokens):
            if t.kind != "name":
                continue
            word = t.text.lower()
            before = self.tokens[i - 1].text if i else ";"
            if word == "namespace" and self._kind(i + 1, "name") and before in (";", "}", "{", "?>") or word == "namespace" and i == 0:
                self.namespace = self.tokens[i + 1].text.strip("\\") if self._kind(i + 1, "name") else ""
            elif word == "use" and before in (";", "}", "{") and self._kind(i + 1, "name") and self._class_at(t.start) is None:
                self._use(i + 1)
            elif word in ("class", "trait", "interface") and self._kind(i + 1, "name") and before not in ("::", "->", "new"):
                self._class(i, word)
            elif word in ("function", "fn") and before not in ("->", "::", "use"):
                self._function(i, word)

    def _use(self, i: int) -> None:
        end = next((j for j in range(i, len(self.tokens)) if self.tokens[j].text in (";", "{")), len(self.tokens))
        for a, b in self.src.split(i, end):
            words = [x.text for x in self.tokens[a:b]]
            if words and words[0].lower() not in ("function", "const"):
                full = words[0].strip("\\")
                alias = words[2] if len(words) >= 3 and words[1].lower() == "as" else full.rpartition("\\")[2]
                self.uses[alias.lower()] = full

    def _class(self, i: int, kind: str) -> None:
        j, parent, interfaces, mode = i + 2, "", [], ""
        while j < len(self.tokens) and self.tokens[j].text != "{":
            word = self.tokens[j].text
            if word.lower() in ("extends", "implements"):
                mode = word.lower()
            elif self.tokens[j].kind == "name" and mode == "extends":
                parent = parent or self._fqn(word)
            elif self.tokens[j].kind == "name":
                interfaces.append(self._fqn(word))
            j += 1
        if j >= len(self.tokens):
            return
        end, traits, rules, name = self.src.close(j), [], [], self.tokens[i + 1].text
        self.classes.append({"name": name, "fqn": f"{self.namespace}\\{name}" if self.namespace else name, "kind": kind, "parent": parent, "interfaces": interfaces, "traits": traits, "rules": rules, "off": self.tokens[i].start, "end_off": self.tokens[end].end, "line": self.src.line(self.tokens[i].start), "first": j, "last": end})
        self._enter(self.classes[-1])
        k = j + 1
        while k < end:
            x = self.tokens[k]
            if x.text == "{":
                k = self.src.close(k)
            elif x.text.lower() == "use" and self._kind(k + 1, "name"):
                m = k + 1
                while m < end and self.tokens[m].text not in (";", "{"):
                    if self.tokens[m].kind == "name":
                        traits.append(self._fqn(self.tokens[m].text))
                    m += 1
                if self._is(m, "{"):
                    rules += self._trait_rules(m)
                    m = self.src.close(m)
                k = m
            elif x.text.lower() == "const":
                m = next((m for m in range(k + 1, end) if self.tokens[m].text == "="), end)
                stop = self._statement_end(m)
                self._symbol("const", f"{name}::{self.tokens[m - 1].text}", m + 1, stop, x.start)
                k = stop
            elif x.kind == "var" and self.tokens[k - 1].text != "->" and self._is(k + 1, "="):
                stop = self._statement_end(k)
                kind_of = "static" if any(self._is(k - d, "static") for d in (1, 2, 3)) else "prop"
                self._symbol(kind_of, x.text[1:], k + 2, stop, x.start, name)
                k = stop
            k += 1

    def _trait_rules(self, brace: int) -> list[dict]:
        """Rules of a trait block: ``A::m insteadof B, C;`` and ``[A::]m as [visibility] [alias];``."""
        out = []
        for a, b in self.src.split(brace + 1, self.src.close(brace), ";"):
            words = [t.text for t in self.tokens[a:b]]
            at = next((n for n, w in enumerate(words) if w.lower() in ("as", "insteadof")), 0)
            if not at:
                continue
            trait = self._fqn(words[0]) if words[1:2] == ["::"] else ""
            others = [self._fqn(w) for w in words[at + 1 :] if w != ","] if words[at].lower() == "insteadof" else []
            names = [w for w in words[at + 1 :] if w.lower() not in ("public", "protected", "private", "final")]
            if others or names:  # a change of visibility alone names nothing
                out.append({"trait": trait, "method": words[at - 1], "alias": "" if others else names[0], "instead": others})
        return out

    def _statement_end(self, i: int) -> int:
        while i < len(self.tokens) and self.tokens[i].text != ";":
            if self.tokens[i].text in "([{" and i in self.src.match:
                i = self.src.match[i]
            i += 1
        return min(i, len(self.tokens))

    def _symbol(self, kind: str, name: str, first: int, last: int, off: int, cls: str = "") -> None:
        value = self.resolve(first, last, off)
        if kind == "const":
            self.scope.constant(name, value)
            cls, _, name = name.rpartition("::")
        elif kind == "define":
            self.scope.constant(name, value)
        else:
            self.scope.props[name] = value
        self.symbols.append({"class": cls, "kind": kind, "name": name, "value": value, "raw": self.src.span(first, last), "off": off})
        if kind in ("prop", "static"):
            self._values.setdefault(name, []).append(self.symbols[-1])

    def _leave(self, off: int) -> None:
        while self._open and self._open[-1]["end_off"] <= off:  # declarations are met in order
            self._open.pop()

    def _enter(self, span: dict) -> None:
        self._leave(span["off"])
        self._open.append(span)

    def _around(self, off: int, which: int) -> tuple[dict, ...]:
        if self._inside is not None:
            return self._inside[which].at(off)
        self._leave(off)
        return tuple(x for x in self._open if ("params" in x) == bool(which) and x["off"] <= off)

    def _class_at(self, off: int) -> dict | None:
        held = self._around(off, 0)
        return held[-1] if held else None

    def _function_at(self, off: int) -> dict | None:
        held = self._around(off, 1)
        return held[-1] if held else None

    def _node(self, function: dict) -> str:
        """A function's name in the call graph; closures are told apart by their place."""
        return f"{function['class_fqn']}::{function['name']}" if function["class_fqn"] else function["name"]

    def _function(self, i: int, word: str) -> None:
        j = i + 1
        if self._is(j, "&"):
            j += 1
        name = self.tokens[j].text if self._kind(j, "name") and self._is(j + 1, "(") and word == "function" else ""
        j += bool(name)
        if not self._is(j, "("):
            return
        close = self.src.close(j)
        params, types = [], {}
        for a, b in self.src.split(j + 1, close):
            own = [x.text for x in self.tokens[a:b] if x.kind == "var"]
            if own:
                params.append(own[0][1:])
                hint = self.tokens[a].text if self.tokens[a].kind == "name" else ""
                if hint and hint.lower() not in _BUILTIN_TYPES:
                    types[own[0][1:]] = self._fqn(hint)
        k = close + 1
        while k < len(self.tokens) and self.tokens[k].text not in ("{", ";", "=>"):
            k = self.src.close(k) + 1 if self.tokens[k].text == "(" else k + 1
        if k >= len(self.tokens) or self.tokens[k].text == ";":
            return
        if self.tokens[k].text == "=>":
            end = k + 1
            while end < len(self.tokens) and self.tokens[end].text not in (",", ";", ")", "]"):
                end = self.src.close(end) + 1 if self.tokens[end].text in "([{" else end + 1
            body = "return " + self.src.span(k + 1, end) + ";"
            last = end - 1
        else:
            last = self.src.close(k)
            body = self.text[self.tokens[k].start : self.tokens[last].end]
        cls, arrow = self._class_at(self.tokens[i].start), self.tokens[k].text == "=>"
        lo, hi, c = self.tokens[k].start, self.tokens[last].end, self.checks
        mods = {self.tokens[m].text.lower() for m in range(max(0, i - 4), i) if self.tokens[m].kind == "name" and self.tokens[m].text.lower() in ("static", "public", "private", "protected", "abstract", "final")} if name else set()
        returns, asked = c.returns(lo, hi, (k + 1, last + 1) if arrow else None)
        self.functions.append(
            {
                "name": name or f"closure@{self.tokens[i].start}", "class": cls["name"] if cls and name else "", "class_fqn": cls["fqn"] if cls and name else "", "is_closure": not name, "types": types, "is_static": "static" in mods,
                "visibility": next((v for v in ("private", "protected") if v in mods), "public"), "params": params, "off": self.tokens[i].start, "end_off": self.tokens[last].end,
                "line": self.src.line(self.tokens[i].start), "body": body, "first": k, "last": last, "level": c.level(lo, hi, self.config), "guard": c.guard(lo, hi), "returns": returns, "returns_of": asked,
                "reads_input": c.reads_input(lo, hi), "fields": c.fields(lo, hi), "keys": re.findall(r"\$\w+\s*\[\s*['\"]([\w.]+)['\"]\s*\]\s*=[^=]", body), "has_nonce": c.has_nonce(lo, hi), "capability": c.capability(lo, hi), "literals": [x for m in re.finditer(r"\breturn\b([^;]*);", body) for x in literals(m[1])], "calls": [], "first_field": c.first_field(lo, hi), "query_var": c.query_var(lo, hi),
            }
        )
        self._enter(self.functions[-1])

    def _assignments(self) -> None:
        for i, t in enumerate(self.tokens):
            if t.kind == "var" and self._is(i + 1, "=") and (i == 0 or self.tokens[i - 1].text not in ("->", "::")):
                if self._class_at(t.start) and not self._function_at(t.start):
                    continue  # a property
                end = self._statement_end(i)
                self.scope.assign(t.text[1:], t.start, i + 2, end)
                self.symbols.append({"class": "", "kind": "var", "name": t.text[1:], "value": self.src.span(i + 2, end), "off": t.start})
            elif t.text == "$this" and self._is(i + 1, "->") and self._kind(i + 2, "name") and self._is(i + 3, "="):
                end = self._statement_end(i)
                if made := self._new_at(i + 4):
                    self.made[(c["fqn"] if (c := self._class_at(t.start)) else "", self.tokens[i + 2].text)] = made
                if self.tokens[i + 2].text not in self.scope.props:
                    cls = self._class_at(t.start)
                    self._symbol("prop", self.tokens[i + 2].text, i + 4, end, t.start, cls["name"] if cls else "")
            elif t.text.lower() == "define" and self._is(i + 1, "(") and (i == 0 or self.tokens[i - 1].text not in ("->", "::", "function")):
                args = self.src.split(i + 2, self.src.close(i + 1))
                if len(args) >= 2 and self.tokens[args[0][0]].kind == "string":
                    self._symbol("define", unquote(self.tokens[args[0][0]].text), *args[1], t.start)
            elif t.text.lower() == "foreach" and self._is(i + 1, "("):
                self._foreach(i)
            elif t.text.lower() in ("include", "include_once", "require", "require_once") and t.kind == "name" and (i == 0 or self.tokens[i - 1].text not in ("->", "::", "function")):
                end = self._statement_end(i)
                self._include(i, end)

    def _foreach(self, i: int) -> None:
        close = self.src.close(i + 1)
        at = next((j for j in range(i + 2, close) if self.tokens[j].text.lower() == "as"), None)
        if at is None:
            return
        names = [x.text[1:] for x in self.tokens[at + 1 : close] if x.kind == "var"]
        source, last = self.src.span(i + 2, at), self.src.close(close + 1) if self._is(close + 1, "{") else self._statement_end(close)
        first = self.tokens[i + 2]
        kind, found = "other", []
        if first.text in ("[", "array"):
            kind, found = "inline", literals(source)
        elif m := re.fullmatch(r"\s*\$(\w+)\s*", source):
            kind, found = "variable", literals(self._last_assign(m[1], self.tokens[i].start) or "")
        elif m := re.fullmatch(r"\s*(?:\$this->|self::\$?|static::\$?)(\w+)\s*", source):
            kind = "property"
            found = [x for s in self._values.get(m[1], ()) for x in literals(s["raw"])]
        elif m := re.fullmatch(r"\s*(?:\$\w+->|self::|static::|\w+::)?(\w+)\s*\(\s*\)\s*", source):
            kind, source = "method", m[1]
        self.foreachs.append({"off": self.tokens[i].start, "end_off": self.tokens[min(last, len(self.tokens) - 1)].end, "kind": kind, "source": source.strip(), "literals": found, "loop_var": names[-1] if names else "", "loop_key": names[0] if len(names) > 1 else ""})

    def _include(self, i: int, end: int) -> None:
        raw, off = self.src.span(i + 1, end), self.tokens[i].start
        parts = literals(raw)
        target = "".join(parts).lstrip("/") if parts else ""
        dynamic = bool(re.search(r"\$(?!this\b)\w+", raw))
        around = self._around(off, 1)
        named = next((f for f in reversed(around) if not f["is_closure"]), None)
        given = self._flows(i + 1, end, named) if dynamic and named else set()
        texts = [(x[1] if x[1] is not None else x[2]).replace("\\", "/") for x in _LITERAL.finditer(named["body"])] if given else []
        hints = [x.strip("/") for x in texts if "/" in x and x.strip("/") and not x.startswith(("http", "//"))]
        self.includes.append({"off": off, "kind": "dynamic" if dynamic else "literal" if target.endswith(".php") else "fragment", "target": target, "raw": collapse(raw, 200), "node": self._node(named) if named else "", "given": sorted(named["params"].index(p) for p in given), "hints": list(dict.fromkeys(hints))})

    def _flows(self, first: int, last: int, function: dict, depth: int = 0) -> set[str]:
        """Parameters of a function that an expression is made of, through its variables' last assignments."""
        found: set[str] = set()
        for t in self.tokens[first:last]:
            names = [t.text[1:]] if t.kind == "var" else [m[2] or m[3] or m[5] for m in _INTERPOLATED.finditer(t.text)] if t.kind == "string" and t.text[0] == '"' else []
            for name in filter(None, names):
                own = self.scope.last(name, self.tokens[first].start, function["off"])
                if own and depth < 5:
                    found |= self._flows(own[1], own[2], function, depth + 1)
                if name in function["params"] and (own is None or any(x.text == "$" + name for x in self.tokens[own[1] : own[2]])):
                    found.add(name)
        return found

    def _last_assign(self, name: str, before: int) -> str | None:
        found = self.scope.last(name, before)
        return self.src.span(*found[1:]) if found else None

    def resolve(self, first: int, last: int, off: int, depth: int = 0) -> str:
        """Value of an expression; what stays unknown becomes ``{name}``."""
        if depth > 5 or first >= last:
            return ""
        return "".join(self._part(a, b, off, depth) for a, b in self.src.split(first, last, "."))

    def _part(self, a: int, b: int, off: int, depth: int) -> str:
        toks = [t.text for t in self.tokens[a:b]]
        if not toks:
            return ""
        t = self.tokens[a]
        if toks[0] == "(" and self.src.match.get(a) == b - 1:
            return self.resolve(a + 1, b - 1, off, depth + 1)
        if t.kind == "string" and len(toks) == 1:
            return unquote(t.text) if t.text[0] == "'" else self._interpolate(unquote(t.text), off, depth)
        if t.kind == "number" and len(toks) == 1:
            return t.text
        if toks[:2] == ["$this", "->"] and len(toks) == 3:
            return self.scope.props.get(toks[2], f"{{{toks[2]}}}") or f"{{{toks[2]}}}"
        if len(toks) == 1 and t.kind == "var":
            return self._variable(t.text[1:], off, depth)
        if len(toks) == 3 and toks[1] == "::":
            return self._constant(toks[0], toks[2].lstrip("$"), off)
        if len(toks) == 1 and t.kind == "name":
            if toks[0] in ("__CLASS__",):
                c = self._class_at(off)
                return c["name"] if c else "{__CLASS__}"
            return self.scope.consts.get(toks[0], f"{{{toks[0]}}}")
        if t.kind == "name" and len(toks) > 1 and toks[1] == "(":
            args = self.src.split(a + 2, self.src.close(a + 1))
            word = toks[0].lower()
            if word in ("__", "_x", "esc_html__", "esc_attr__", "untrailingslashit", "trailingslashit", "trim", "strtolower", "sanitize_title", "sanitize_key", "apply_filters") and args:
                inner = args[1] if word == "apply_filters" and len(args) > 1 else args[0]
                return self.resolve(*inner, off, depth + 1)
            if word == "sprintf" and args:
                form = self.resolve(*args[0], off, depth + 1)
                values = iter([self.resolve(*x, off, depth + 1) for x in args[1:]])
                return re.sub(r"%(?:\d+\$)?[sd]", lambda _: next(values, "{dynamic}"), form)
            return "{dynamic}"
        names = [x.lstrip("$") for x in toks if re.fullmatch(r"\$?[A-Za-z_]\w*", x) and x != "$this"]
        return f"{{{names[-1]}}}" if names else "{dynamic}"

    def _variable(self, name: str, off: int, depth: int) -> str:
        here = self._function_at(off)
        own = self.scope.last(name, off, here["off"] if here else 0)
        if own:
            value = self.resolve(own[1], own[2], own[0], depth + 1)
            if value and value != "{dynamic}" and self.tokens[own[1]].text not in ("[", "array"):
                return value
        return f"{{{name}}}"

    def _constant(self, cls: str, name: str, off: int) -> str:
        if cls.lower() in ("self", "static"):
            c = self._class_at(off)
            cls = c["name"] if c else cls
        found = self.scope.consts.get(f"{cls}::{name}") or self.scope.props.get(name)
        if found is None:
            found = self.scope.lower.get(f"{cls}::{name}".lower())
        return found if found is not None else f"{{{name}}}"

    def _interpolate(self, text: str, off: int, depth: int) -> str:
        def one(m: re.Match) -> str:
            prop, var = m[1] or m[4], m[2] or m[3] or m[5]
            if prop:
                return self.scope.props.get(prop, f"{{{prop}}}")
            return self._variable(var, off, depth + 1) if var != "this" else "{dynamic}"

        return _INTERPOLATED.sub(one, text)

    def callback(self, first: int, last: int) -> str:
        """Name of a callback: ``this::m``, ``Class::m``, ``f``, ``closure@offset`` or ``unknown``."""
        toks = self.tokens[first:last]
        texts = [t.text for t in toks]
        if not toks:
            return "unknown"
        lower = [x.lower() for x in texts]
        if "function" in lower[:2] or "fn" in lower[:2]:
            k = next(i for i, x in enumerate(lower) if x in ("function", "fn"))
            return f"closure@{toks[k].start}"
        if toks[0].kind == "string" and len(toks) == 1:
            return unquote(texts[0]).lstrip("\\")
        if texts[0] == "[" or lower[0] == "array" and len(texts) > 1 and texts[1] == "(":
            open_at = first + (texts[0] != "[")
            items = self.src.split(open_at + 1, self.src.close(open_at))
            if len(items) >= 2:
                a, b = items[0]
                method = self.resolve(*items[1], toks[0].start)
                head = [t.text for t in self.tokens[a:b]]
                if head[:1] == ["$this"] and len(head) == 1 or head[0].lower() in ("self", "static", "__class__"):
                    return f"this::{method}"
                if head[0].lower() == "new" and len(head) > 1:
                    return f"{head[1].rpartition(chr(92))[2]}::{method}"
                if len(head) >= 3 and head[1] == "::" and head[2].lower() == "class":
                    return f"{head[0].rpartition(chr(92))[2]}::{method}"
                if self.tokens[a].kind == "string":
                    return f"{unquote(head[0]).rpartition(chr(92))[2]}::{method}"
                return f"{head[-1].lstrip('$')}::{method}"
        if len(texts) >= 3 and texts[-3:] == ["(", "...", ")"]:  # first-class callable
            return ("this::" if texts[0] == "$this" else "") + texts[-4]
        if lower[0] in ("self", "static", "$this") and len(texts) == 3:
            return f"property:{''.join(texts)}" if texts[0] == "$this" else f"this::{texts[2]}"
        return "dynamic_callback" if toks[0].kind == "var" else "unknown"

    def _calls(self) -> None:
        toks = self.tokens
        for i, t in enumerate(toks):
            if t.kind not in ("name", "var") or not self._is(i + 1, "("):
                continue
            before = toks[i - 1].text.lower() if i else ""
            if t.kind == "var" and before not in ("->", "::") or before in ("function", "&") and self._is(i - 2 if before == "&" else i - 1, "function"):
                continue
            kind, receiver = "none", ""
            if before in ("->", "?->"):
                kind, receiver = "var", toks[i - 2].text if i > 1 else ""
                if receiver == "$this":
                    kind = "this"
                elif i > 3 and toks[i - 3].text == "->" and toks[i - 2].kind == "name":
                    receiver = toks[i - 4].text + "->" + receiver
            elif before == "::":
                kind, receiver = "static", toks[i - 2].text if i > 1 else ""
            elif before == "new":
                kind, receiver = "new", t.text
            if kind == "none" and t.text.lower() in _KEYWORDS:
                continue
            close = self.src.close(i + 1)
            self._call(i, close, t.text if t.kind == "name" else "{dynamic}", kind, receiver)

    def _call(self, i: int, close: int, callee: str, kind: str, receiver: str) -> None:
        off = self.tokens[i].start
        args = self.src.split(i + 2, close)
        cls, around = self._class_at(off), self._around(off, 1)
        fn = around[-1] if around else None
        for holder in around:  # a closure's calls belong to the function around it, too
            holder["calls"].append((callee.rpartition("\\")[2], kind, receiver))
        items = []
        for n, (a, b) in enumerate(args):
            start = a
            if self.tokens[a].kind == "var" and b - a == 1 and (x := self.scope.last(self.tokens[a].text[1:], off)):
                start = x[1]  # the last assignment before the call
            items += self._items(n, start, -1, off)
        self.calls.append(
            {
                "off": off, "line": self.src.line(off), "callee": callee.rpartition("\\")[2], "receiver_kind": kind, "receiver": receiver,
                "args": [self.src.span(a, b) for a, b in args], "vals": [self.resolve(a, b, off) for a, b in args], "callbacks": [self.callback(a, b) for a, b in args],
                "items": items, "raw": self.text[off : self.tokens[close].end], "enclosing_class": cls["name"] if cls else "", "enclosing_fn": fn["name"] if fn else "", "class_fqn": cls["fqn"] if cls else "", "type": self._type(kind, receiver, callee, off), "holders": [self._node(f) for f in around], "loops": [x["off"] for x in self._loops.at(off)],
                "context_level": self.checks.level(max(0, off - 500), self.tokens[close].end + 500, self.config), "raw_level": self.checks.level(off, self.tokens[close].end, self.config),
                "before": self.text[max(0, off - 200) : off],
            }
        )

    def _type(self, kind: str, receiver: str, callee: str, off: int) -> str:
        """Class that a call's receiver is of: a name, ``this`` or ``parent``; empty where nothing says so."""
        if kind in ("this", "static") and receiver.lower() in ("$this", "self", "static"):
            return "this"
        if kind == "static":
            return "parent" if receiver.lower() == "parent" else self._type_of(receiver, off) if receiver.startswith("$") else self._fqn(receiver)
        if kind == "new":
            return "" if callee.startswith(("$", "{")) else "this" if receiver.lower() in ("self", "static") else self._fqn(receiver)
        return self._type_of(receiver, off) if kind == "var" else ""

    def _type_of(self, name: str, off: int) -> str:
        """Class of a variable or of a property of ``$this``: its last ``new``, or the parameter's type."""
        if name.startswith("$this->"):
            return self.made.get((c["fqn"] if (c := self._class_at(off)) else "", name[7:]), "")
        here = self._function_at(off)
        last = self.scope.last(name[1:], off, here["off"] if here else 0)
        if last:
            return self._new_at(last[1])
        return here["types"].get(name[1:], "") if here else ""

    def _new_at(self, i: int) -> str:
        return self._fqn(self.tokens[i + 1].text) if self._is(i, "new") and self._kind(i + 1, "name") and self.tokens[i + 1].text.lower() not in ("self", "static", "class") else ""

    def _direct_actions(self) -> None:
        """Comparisons of a request's ``action`` with a literal, as calls of ``__direct_action``."""
        for m in _DIRECT.finditer(self.text):
            name = m[1] or m[2]
            if name not in ("-1", "false", "0"):
                lo, hi = max(0, m.start() - 500), m.end() + 500
                fn, cls = self._function_at(m.start()), self._class_at(m.start())
                self.calls.append({"off": m.start(), "line": self.src.line(m.start()), "callee": "__direct_action", "receiver_kind": "none", "receiver": "", "args": [m[0]], "vals": [name], "callbacks": ["inline"], "items": [], "raw": m[0], "enclosing_class": cls["name"] if cls else "", "enclosing_fn": fn["name"] if fn else "", "class_fqn": cls["fqn"] if cls else "", "type": "", "holders": [self._node(f) for f in self._around(m.start(), 1)], "loops": [], "context_level": self.checks.level(lo, hi, self.config), "raw_level": 0, "before": ""})

    def direct(self) -> bool:
        """Whether the first 100 lines, without namespace or bootstrap guard, read the request at once."""
        head = "\n".join(self.text.split("\n")[:100])
        code = [x for x in re.sub(r"<\?(?:php)?", "", head).split("\n") if x.strip()]
        return self.checks.reads_request(0, len(head)) and not _BOOTSTRAP.search(head) and not (code and code[0].strip().startswith("namespace"))

    def _items(self, arg: int, a: int, group: int, off: int, depth: int = 0) -> list[dict]:
        """``key => value`` pairs of an array literal; pairs of inner arrays carry the number of theirs."""
        if self._is(a, "["):
            open_at = a
        elif self._is(a, "array") and self._is(a + 1, "("):
            open_at = a + 1
        else:
            return []
        out: list[dict] = []
        for n, (x, y) in enumerate(self.src.split(open_at + 1, self.src.close(open_at))):
            arrow = self._arrow(x, y)
            if arrow is None:
                out.append({"arg": arg, "grp": group, "key": f"#{n}", "value": self.src.span(x, y), "val": self.resolve(x, y, off), "cb": self.callback(x, y)})
                if depth < 1:
                    out += self._items(arg, x, n, off, depth + 1)
                continue
            out.append({"arg": arg, "grp": group, "key": self.resolve(x, arrow, off), "value": self.src.span(arrow + 1, y), "val": self._value(arrow + 1, y, off), "cb": self.callback(arrow + 1, y)})
        return out

    def _arrow(self, x: int, y: int) -> int | None:
        """The ``=>`` of a pair in x..y-1, outside brackets and before any arrow function."""
        j = x
        while j < y and self.tokens[j].text.lower() != "fn":
            if self.tokens[j].text == "=>":
                return j
            j = self.src.match[j] + 1 if self.tokens[j].text in "([{" and j in self.src.match else j + 1
        return None

    def _value(self, a: int, b: int, off: int) -> str:
        toks = [t.text for t in self.tokens[a:b]]
        if "[" in toks[:1] or toks[:2] == ["array", "("]:
            return ",".join(literals(self.src.span(a, b)))
        if len(toks) == 3 and toks[1] == "::" and toks[2].isupper():
            own = self._constant(toks[0], toks[2], off)
            return toks[2] if own.startswith("{") else own
        return self.resolve(a, b, off)


def literals(code: str) -> list[str]:
    """String literals in order; keys of pairs are left out."""
    return [m[1] if m[1] is not None else m[2] for m in _LITERAL.finditer(code) if not _KEY_FOLLOWS.match(code, m.end())]


def header(text: str) -> dict[str, str]:
    """Plugin name and version of starred or slashed comment lines."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:\*|//)\s*(Plugin Name|Version)\s*:\s*(.*?)\s*(?:\*/)?$", line)
        if m:
            out.setdefault(m[1], m[2])
    return out


def facts(text: str, config: Config | None = None) -> dict:
    """All facts of a file, without bodies and token numbers."""
    f = File(text, config)
    drop = {"first", "last", "body", "types"}
    kept = [{k: v for k, v in x.items() if k not in drop} for x in f.functions]
    for x in kept:
        x["asks"] = [c for kind in (("this", "var"), ("static",)) for c in [c for c, k, _ in x["calls"] if k in kind][:DELEGATES]]
        # the order in which a capability is looked for: static, instance, plain calls, each as written
        x["ordered"] = list(dict.fromkeys(c for kinds in (("static",), ("this", "var"), ("none",)) for c, k, _ in x["calls"] if k in kinds))
        x["calls"] = sorted({c for c, _, _ in x["calls"]})
    return {"functions": kept, "classes": [{k: v for k, v in c.items() if k not in drop} for c in f.classes], "calls": f.calls, "symbols": f.symbols, "foreachs": f.foreachs, "includes": f.includes, "namespace": f.namespace, "uses": sorted(f.uses.items()), "direct": f.direct()}
