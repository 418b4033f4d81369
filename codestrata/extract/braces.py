"""Readers of TypeScript, JavaScript (with JSX) and Java: a tokenizer, matched brackets and patterns over tokens.

Not read: declarations spread over macros or preprocessors, overload signatures without bodies and object-literal
methods. A bracket without its partner is reported and passed over: an opening one reaches to where the brackets around it close.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .captures import Capture, Mark

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<name>[#@]?[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\?\.|&&|\|\||\.\.\.|[^\w\s])""",
    re.S,
)
#: A part of a template text, from its beginning or a closed hole to its end or the next hole.
TEMPLATE = re.compile(r"[`}](?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|$)", re.S)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words after which a slash begins a regular expression.
BEFORE_REGEX = set("return typeof case in of do else void delete throw new await yield instanceof".split())
OPEN, CLOSE = {"(": ")", "{": "}", "[": "]"}, {")", "}", "]"}
NOT_CALLED = set("if for while switch catch function return typeof new super await yield in of do else throw delete void instanceof case constructor package".split())
MODIFIERS = set("public private protected static readonly abstract final async override declare get set synchronized native default transient volatile export".split())


class Braces:
    def __init__(self, source: str, lang: str):
        self.source, self.lang, self.java = source, lang, lang == "java"
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.t: list[tuple[str, str, int, int]] = self.tokens()
        self.match: dict[int, int] = {}
        self.out: list[Capture] = []
        self.wrong: list[int] = []
        stack: list[int] = []
        for i, (kind, x, _, _) in enumerate(self.t):
            if kind == "op" and x in OPEN:
                stack.append(i)
            elif kind == "op" and x in CLOSE:
                depth = next((d for d in range(len(stack) - 1, -1, -1) if OPEN[self.t[stack[d]][1]] == x), None)
                if depth is None:
                    self.wrong.append(i)
                    continue
                self.give_up(stack[depth + 1 :], i - 1)
                self.match[stack[depth]] = i
                del stack[depth:]
        self.give_up(stack, len(self.t) - 1)
        self.back = {b: a for a, b in self.match.items()}

    def give_up(self, opened: list[int], last: int) -> None:
        """Opening brackets that nothing closes reach to the token `last`."""
        self.wrong += opened
        for i in opened:
            self.match[i] = max(i, last)

    def tokens(self) -> list[tuple[str, str, int, int]]:
        """(kind, text, start, end) of what isn't space or comment; the holes of a template text are read as blocks between its parts."""
        source, out, at = self.source, [], 0
        holes: list[int] = []  # how many braces are open in each template hole that we are in
        while at < len(source):
            x = source[at]
            if x == "`" and not self.java or x == "}" and holes and holes[-1] == 0:
                if x == "}":
                    holes.pop()
                    out.append(("op", "}", at, at + 1))
                m = TEMPLATE.match(source, at)
                opens = m[1] == "${"
                out.append(("str", m[0], at, m.end() - 2 * opens))
                at = m.end()
                if opens:
                    holes.append(0)
                    out.append(("op", "{", at - 2, at))
                continue
            if x == "/" and not self.java and self.regex_may_follow(out) and (m := REGEX.match(source, at)):
                out.append(("str", m[0], at, m.end()))
                at = m.end()
                continue
            m = TOKEN.match(source, at)
            if holes and x in "{}":
                holes[-1] += 1 if x == "{" else -1
            if m.lastgroup != "skip":
                out.append((m.lastgroup, m[0], at, m.end()))
            at = m.end()
        return out

    @staticmethod
    def regex_may_follow(out: list[tuple[str, str, int, int]]) -> bool:
        kind, text = out[-1][:2] if out else ("op", "")
        return text in BEFORE_REGEX if kind == "name" else kind == "op" and text not in (")", "]", "}")

    def pos(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset) - 1
        return line, offset - self.starts[line]

    def span(self, i: int, j: int) -> tuple[int, int, int, int]:
        """From the start of token i to the end of token j."""
        return *self.pos(self.t[i][2]), *self.pos(self.t[j][3])

    def x(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i][0] == "name"

    def dotted(self, i: int) -> tuple[list[str], int]:
        """Names joined by dots from token i on, and the last token."""
        parts = [self.x(i)]
        while self.x(i + 1) in (".", "?.") and self.is_name(i + 2):
            i += 2
            parts.append(self.x(i))
        return parts, i

    def marks_before(self, i: int) -> tuple[list[Mark], set[str], int]:
        """Decorators and modifiers before token i, and where they begin."""
        words: set[str] = set()
        first = i
        while first > 0:
            p = first - 1
            if self.x(p) in MODIFIERS:
                words.add(self.x(p))
                first = p
            elif self.x(p) == ")" and (o := self.back.get(p)) is not None and self.x(o - 1).startswith("@"):
                first = o - 1
            elif self.x(p).startswith("@"):
                first = p
            else:
                break
        return [self.mark(k) for k in range(first, i) if self.x(k).startswith("@")], words, first

    def mark(self, k: int) -> Mark:
        """The decorator at token k."""
        chain, last = self.dotted(k)
        found = Mark(chain[-1].removeprefix("@"), len(chain) > 1)
        if self.x(last + 1) == "(" and (close := self.match.get(last + 1)):
            found.raw = self.source[self.t[last + 1][3] : self.t[close][2]]
            if last + 2 < close and self.t[last + 2][0] == "str":
                found.first = self.x(last + 2)[1:-1]
            for j in range(last + 2, close - 1):
                if self.is_name(j) and self.x(j + 1) in (":", "=") and self.t[j + 2][0] == "str":
                    found.named.setdefault(self.x(j), []).append(self.x(j + 2)[1:-1])
        return found

    def seen(self, words: set[str], name: str) -> tuple[bool, str]:
        if self.java:
            return "public" in words, next((w for w in ("private", "protected", "public") if w in words), "public")
        return "export" in words, "private" if name.startswith("#") or "private" in words else "protected" if "protected" in words else "public"

    def body_of(self, i: int, stop=";") -> int | None:
        """The next opening brace at this level before `stop`."""
        while i < len(self.t):
            if self.x(i) == "{":
                return i
            if self.x(i) in stop or self.x(i) in CLOSE:
                return None
            i = self.match.get(i, i) + 1
        return None

    def read(self) -> list[Capture]:
        for i in sorted(self.wrong):
            line, column = self.pos(self.t[i][2])
            self.out.append(Capture("error", "", (line, column, line, column), (line, column, line, column)))
        self.block(0, len(self.t), None, False)
        return self.out

    def add(self, tag, i, j, name_i, name=None, **more):
        self.out.append(Capture(tag, name if name is not None else self.x(name_i), self.span(i, j), self.span(name_i, more.pop("name_j", name_i)), **more))

    def block(self, i: int, end: int, in_class: str | None, exported: bool) -> None:
        """Reads tokens i to end; in_class: the class's name if these are a class's members."""
        while i < end:
            i = self.one(i, end, in_class, exported)

    def one(self, i: int, end: int, in_class: str | None, exported: bool) -> int:
        x = self.x(i)
        if x == "import" and not in_class and self.x(i + 1) not in ("(", "."):
            return self.imports(i, end)
        if x in ("class", "interface") and self.is_name(i + 1) and self.x(i - 1) != "." and (b := self.body_of(i + 2)) is not None:
            return self.type_(i, b, exported)
        if x == "function" and not self.java and self.x(i - 1) != ".":
            star = self.x(i + 1) == "*"
            n = i + 1 + star
            if self.is_name(n) and self.x(n + 1) in ("(", "<") and (b := self.body_of(n + 1)) is not None:
                return self.callable_(i, n, b, "definition.function", exported)
        if not self.java and x == "type" and self.is_name(i + 1) and self.x(i + 2) in ("=", "<") and self.lang in ("typescript", "tsx"):
            j = i + 2
            while j < end and self.x(j) != ";" and not (self.pos(self.t[j][2])[0] > self.pos(self.t[j - 1][3])[0] and self.x(j - 1) not in "=|&"):
                j = self.match.get(j, j) + 1
            _, words, _ = self.marks_before(i)
            self.add("definition.type_alias", i, min(j, end - 1), i + 1, exported="export" in words or exported)
            return j
        if in_class and self.is_name(i) and x not in MODIFIERS and not x.startswith("@"):
            j = self.member(i, end, in_class, exported)
            if j:
                return j
        if x in ("const", "let", "var") and self.is_name(i + 1) and not self.java:
            return self.declared(i, end, exported)
        if self.java and not in_class and self.is_name(i) and self.is_name(i + 1) and self.x(i + 2) in ("=", ";") and x not in NOT_CALLED:
            self.add("definition.variable", i + 1, self.until(i + 1, end), i + 1, node_type="variable_declarator", type_chain=[x])
            return i + 2
        self.uses(i)
        if x == "{" and i in self.match and self.x(i - 1) not in ("=>",):
            self.block(i + 1, self.match[i], None, exported)
            return self.match[i] + 1
        return i + 1

    def until(self, i: int, end: int) -> int:
        j = i
        while j + 1 < end and self.x(j + 1) not in (";", ",") and not self.x(j + 1) in CLOSE:
            if self.pos(self.t[j + 1][2])[0] > self.pos(self.t[j][3])[0] and self.x(j) not in ("=", "=>", ".", ",", "(", "?", ":") and self.x(j + 1) not in (".", "?", ":", "+", "=", "?."):
                break
            j = self.match.get(j + 1, j + 1)
        return j

    def type_(self, i: int, b: int, exported: bool) -> int:
        marks, words, _ = self.marks_before(i)
        name, close = self.x(i + 1), self.match[b]
        out, seen = self.seen(words, name)
        kind = "definition.class" if self.x(i) == "class" else "definition.interface"
        bases = self.source[self.t[i + 1][3] : self.t[b][2]]
        self.add(kind, i, close, i + 1, node_type="class_declaration" if kind.endswith("class") else "interface_declaration", marks=marks, bases=bases, exported=out or exported, visibility=seen)
        j, tag = i + 2, None
        while j < b:
            if self.x(j) in ("extends", "implements"):
                tag = "implement" if self.x(j) == "implements" else "inherit"
            elif tag and self.is_name(j):
                chain, last = self.dotted(j)
                self.add(tag, j, last, j, ".".join(chain), name_j=last, node_type=tag, chain=chain)
                j = last
                if self.x(j + 1) == "<":  # type arguments
                    depth, j = 1, j + 2
                    while j < b and depth:
                        depth += (self.x(j) == "<") - (self.x(j) == ">")
                        j += 1
                    continue
            j += 1
        self.block(b + 1, close, name, out or exported)
        return close + 1

    def callable_(self, i: int, n: int, b: int, tag: str, exported: bool) -> int:
        marks, words, _ = self.marks_before(i)
        out, seen = self.seen(words, self.x(n))
        close = self.match[b]
        self.add(tag, i, close, n, node_type=tag, marks=marks, exported=out or exported, visibility=seen)
        for k in range(n + 1, b):
            self.uses(k)
        self.block(b + 1, close, None, out or exported)
        return close + 1

    def member(self, i: int, end: int, owner: str, exported: bool) -> int | None:
        n = i
        if self.java and not (self.x(i) == owner and self.x(i + 1) == "("):
            _, n = self.dotted(i)
            n += 1
            if self.x(n) == "<":
                depth, n = 1, n + 1
                while n < end and depth:
                    depth += (self.x(n) == "<") - (self.x(n) == ">")
                    n += 1
            while self.x(n) in ("[", "]"):
                n += 1
            if not self.is_name(n):
                return None
        if self.x(n + 1) in ("(", "<") and (b := self.body_of(n + 1)) is not None:
            return self.callable_(i, n, b, "definition.method", exported)
        optional = self.x(n + 1) in ("?", "!")
        if self.x(n + 1 + optional) in (":", "=", ";") or self.java and self.x(n + 1) in ("=", ";", ","):
            last = self.until(n, end)
            marks, words, _ = self.marks_before(i)
            out, seen = self.seen(words, self.x(n))
            kind = [self.x(i)] if self.java else self.type_at(n + 1 + optional, last)
            self.add("definition.variable", n, last, n, node_type="field", type_chain=kind, exported=out or exported, visibility=seen)
            for k in range(n + 1, last + 1):
                self.uses(k)
            return last + 1
        return None

    def type_at(self, i: int, last: int) -> list[str]:
        """The type of a declaration: its annotation, else what `new` makes."""
        if self.x(i) == ":" and self.is_name(i + 1) and self.x(i + 1)[:1].isupper():
            return self.dotted(i + 1)[0]
        for k in range(i, last):
            if self.x(k) == "=":
                return self.dotted(k + 2)[0] if self.x(k + 1) == "new" and self.is_name(k + 2) else []
        return []

    def declared(self, i: int, end: int, exported: bool) -> int:
        _, words, _ = self.marks_before(i)
        last = self.until(i + 1, end)
        self.add("definition.variable", i + 1, last, i + 1, node_type="variable_declarator", type_chain=self.type_at(i + 2, last), exported="export" in words or exported)
        return i + 2

    def imports(self, i: int, end: int) -> int:
        if self.java:
            n = i + 1 + (self.x(i + 1) == "static")
            chain, last = self.dotted(n)
            star = self.x(last + 1) == "." and self.x(last + 2) == "*"
            path = ".".join(chain) + (".*" if star else "")
            self.add("import", i, last, n, path, name_j=last, node_type="import_declaration", chain=chain, import_path=path, imported=path)
            return last + 1 + 2 * star
        j = i + 1
        while j < end and self.t[j][0] != "str" and self.x(j) != ";":
            j += 1
        if j >= end or self.t[j][0] != "str":
            return i + 1
        path, k = self.x(j)[1:-1], i + 1
        put = lambda n, real=None: self.add("import", i, j, n, node_type="import_specifier", chain=[self.x(n)], import_path=path, imported=real)
        while k < j:
            if self.x(k) in ("type", "from", ",", "{", "}"):
                k += 1
            elif self.x(k) == "*" and self.x(k + 1) == "as":
                put(k + 2)
                k += 3
            elif self.x(k + 1) == "as":
                put(k + 2, self.x(k))
                k += 3
            elif self.is_name(k):
                put(k)
                k += 1
            else:
                k += 1
        return j + 1

    def uses(self, i: int) -> None:
        """Calls, instantiations, type uses and renderings that begin at token i."""
        x = self.x(i)
        if x == "new" and self.is_name(i + 1):
            chain, last = self.dotted(i + 1)
            self.add("new", i, last, i + 1, ".".join(chain), name_j=last, node_type="new_expression", chain=chain)
        elif x == "<" and self.lang in ("tsx", "jsx", "javascript") and self.is_name(i + 1) and (self.x(i - 1) in ("(", "=", "?", ":", "&&", "||", "{", "}", ">", "=>", ",", "") or self.x(i - 1) == "return"):
            chain, last = self.dotted(i + 1)
            self.add("renders", i, last, i + 1, ".".join(chain), name_j=last, node_type="jsx", chain=chain)
        elif x == ":" and self.lang in ("typescript", "tsx") and self.is_name(i + 1) and self.dotted(i + 1)[0][-1][:1].isupper():
            chain, last = self.dotted(i + 1)
            self.add("type_use", i, last, i + 1, ".".join(chain), name_j=last, node_type="type_annotation", chain=chain)
        elif self.is_name(i) and self.x(i - 1) not in (".", "?.", "new", "function", "class", "interface", "<") and x not in NOT_CALLED:
            chain, last = self.dotted(i)
            if self.x(last + 1) == "(" and self.match.get(last + 1) is not None:
                close = self.match[last + 1]
                route = self.route(chain, last + 1, close)
                self.add("call", i, close, i, ".".join(chain), name_j=last, node_type="call", chain=chain, route=route)

    def route(self, chain: list[str], a: int, b: int) -> tuple[str, str] | None:
        """(METHOD path, handler) of a call that looks like a route's registration."""
        verbs = ("get", "post", "put", "delete", "patch", "use")
        if len(chain) < 2 or chain[-1] not in verbs or not any(w in ".".join(chain[:-1]).lower() for w in ("app", "router", "route")):
            return None
        texts = [self.x(k)[1:-1] for k in range(a, b) if self.t[k][0] == "str"]
        return (f"{chain[-1].upper()} {texts[-1]}", " ".join(".".join(self.dotted(k)[0]) for k in range(a, b) if self.is_name(k) and self.x(k - 1) not in (".", "?."))) if texts else None
