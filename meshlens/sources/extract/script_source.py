"""Facts of JavaScript and TypeScript sources by a bracket-matching scanner.

The scanner cuts a source into tokens, pairs its brackets, and finds around any place the enclosing blocks: named
functions, try blocks, calls. That is enough for call sites with their method, URL, owner, handling, read and sent fields,
for type shapes, Express routes and mounts, file routes and tRPC routers. It is no full parser. Its tokens come from a
stack of modes: code, templates with code in them, elements and their text, and regular expressions by the token before.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cached_property

from meshlens.sources.extract.graphql_source import document_fields

Fact = tuple[str, dict]
TOKEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_$][\w$]*|\d[\w.]*|=>|\.\.\.|\?\.|[^\s]", re.S)
BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
#: A token behind any blanks before it, which it takes nothing from.
STEP = re.compile(f"(?>{BLANK.pattern})?+({TOKEN.pattern})", re.S)
#: Tokens that may begin something longer, or that open and close code.
TURNS = {"`", "/", "<", "{", "}"}
OPENING, CLOSING = {"(", "[", "{"}, {")", "]", "}"}
PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[a-z]*")
#: So many slashes that no pattern follows, though one might, and a source's others are divisions.
TRIES = 100
ELEMENT = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>{])(?!\s+extends\b))")
CHILD = re.compile("[<{]")
PLAIN = re.compile(r"[^`\\$]+")
#: Words after which an operand begins.
BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "default"}
WORD = re.compile(r"[A-Za-z_$][\w$]*\Z")
#: Fixed values.
VERBS = {"get", "post", "put", "delete", "patch"}
BUILTINS = {"then", "catch", "finally", "json", "map", "filter", "forEach", "find", "findIndex", "reduce", "some", "every", "includes", "concat", "join", "sort", "reverse", "push", "pop", "shift", "slice", "splice", "keys", "values", "entries", "length", "indexOf", "at", "flat", "flatMap", "toString", "hasOwnProperty"}
HOOKS = {"useQuery", "useMutation", "useInfiniteQuery", "useSuspenseQuery"}
TRPC_ROOTS = ("trpc", "api", "client")
TRPC_VERBS = {"useQuery": "QUERY", "useMutation": "MUTATION", "useInfiniteQuery": "QUERY", "useSuspenseQuery": "QUERY", "query": "QUERY", "mutate": "MUTATION", "fetch": "QUERY"}
CLIENT = re.compile(r"(axios|api\w*|client|http)\Z", re.I)
OWN_CLIENT = re.compile(r"(api\w*|client|http)\Z", re.I)
AUTH = re.compile(r"auth|login|jwt|passport|session|permission|protect|guard|verify", re.I)
BODY_METHODS = {"POST", "PUT", "PATCH"}


class Lexer:
    """Tokens (place, text) of a source. A template is one token, with the code in it; text between elements and comments are none."""

    def __init__(self, source: str, elements: bool) -> None:
        self.source, self.elements, self.tries = source, elements, TRIES
        self.found: list[tuple[int, str]] = []

    def operand_next(self) -> bool:
        """Whether an operand may begin here, so that a slash opens a pattern and an angle bracket an element."""
        last = self.found[-1][1] if self.found else ""
        return last in BEFORE_OPERAND or not (last[-1:] in (")", "]", "'", '"', "`") or last[:1].isalnum() or last[:1] in ("_", "$"))

    def code(self, at: int, inner: bool = False) -> int | None:
        """Reads code to the end, or to the brace that closes it: its place, or None if there is none."""
        source, found, depth, step = self.source, self.found, 0, STEP.match
        while m := step(source, at):
            at, end = m.span(1)
            c = m[1]
            if c not in TURNS:
                found.append((at, c))
                at = end
                continue
            if c == "`":
                end = self.template(at)
            elif c == "/":
                if self.tries and self.operand_next():
                    m = PATTERN.match(source, at)
                    self.tries -= m is None
                    end = m.end() if m else end
            elif c == "<":
                if self.elements and self.operand_next() and ELEMENT.match(source, at):
                    kept = len(found)
                    after = self.element(at)
                    if after is not None:
                        at = after
                        continue
                    del found[kept:]
                    self.elements = False  # what doesn't close is no element; nothing after it is taken for one
            else:
                depth += 1 if c == "{" else -1
                if inner and depth < 0:
                    return at
            found.append((at, source[at:end]))
            at = end
        return None if inner else len(source)

    def template(self, at: int) -> int:
        return template_parts(self.source, at, self.elements)[1]

    def braced(self, at: int) -> int | None:
        """Code in braces, with them: the place after it."""
        self.found.append((at, "{"))
        end = self.code(at + 1, True)
        if end is None:
            return None
        self.found.append((end, "}"))
        return end + 1

    def element(self, at: int) -> int | None:
        """An element with its attributes and children: the place after it, or None if it doesn't close. Elements in it lie on a stack."""
        source, open_ = self.source, 0
        while True:
            # a tag begins here
            closing = source.startswith("</", at)
            self.found.append((at, "<"))
            at += 1
            alone = False
            while True:
                if blank := BLANK.match(source, at):
                    at = blank.end()
                if at >= len(source):
                    return None
                c = source[at]
                if c == "{":
                    at = self.braced(at)
                    if at is None:
                        return None
                    continue
                if c in "'\"":  # no escapes, and any lines
                    end = source.find(c, at + 1) + 1
                    if not end:
                        return None
                elif c == "<" and self.found[-1][1] == "=":
                    at = self.element(at)
                    if at is None:
                        return None
                    continue
                elif c == "`":
                    end = self.template(at)
                else:
                    end = TOKEN.match(source, at).end()
                self.found.append((at, source[at:end]))
                at = end
                if c == ">" and self.found[-2][1] != "=":
                    alone = self.found[-2][1] == "/"
                    break
            open_ += -1 if closing else 0 if alone else 1
            if open_ <= 0:
                return at
            # its children: text is passed over
            while True:
                child = CHILD.search(source, at)
                if child is None:
                    return None
                at = child.start()
                if source[at] == "<":
                    break
                at = self.braced(at)
                if at is None:
                    return None


def template_parts(source: str, at: int, elements: bool = False) -> tuple[list[str | None], int]:
    """Texts of the template that begins here, with None for code between them, and the place after it."""
    parts: list[str | None] = []
    begin = at = at + 1
    while at < len(source) and source[at] != "`":
        if plain := PLAIN.match(source, at):
            at = plain.end()
        elif source[at] == "\\":
            at += 2
        elif source.startswith("${", at):
            parts += [source[begin:at], None]
            end = Lexer(source, elements).code(at + 2, True)
            begin = at = len(source) if end is None else end + 1
        else:
            at += 1
    parts.append(source[begin : min(at, len(source))])
    return parts, min(at + 1, len(source))


class Script:
    def __init__(self, source: str, elements: bool = True) -> None:
        lexer = Lexer(source, elements)
        lexer.code(0)
        self.source, self.at = source, [at for at, _ in lexer.found]
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.text = text = [text for _, text in lexer.found]
        self.size = len(text)
        self.pair = pair = {}
        self.parent = parent = []
        stack, above = [], -1
        for i, t in enumerate(text):
            parent.append(above)
            if t in OPENING:
                stack.append(i)
                above = i
            elif t in CLOSING and stack:
                pair[above] = i
                pair[i] = stack.pop()
                above = stack[-1] if stack else -1
        #: Round brackets that close.
        self.rounds = [i for i, t in enumerate(text) if t == "(" and i in pair]

    def word(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.size else ""

    def line(self, i: int) -> int:
        return bisect.bisect_left(self.breaks, self.at[i]) + 1

    def code(self) -> str:
        """The source without its comments."""
        return " ".join(self.text)

    def close(self, i: int) -> int:
        return self.pair.get(i, len(self.text) - 1)

    def span(self, a: int, b: int) -> str:
        return self.source[self.at[a] : self.at[b] + len(self.text[b])] if a <= b < len(self.text) else ""

    def arguments(self, opening: int) -> list[tuple[int, int]]:
        """Token ranges of the comma-separated items inside a bracket."""
        out, begin, i, end = [], opening + 1, opening + 1, self.close(opening)
        while i < end:
            if self.text[i] in "([{":
                i = self.close(i)
            elif self.text[i] == ",":
                out.append((begin, i - 1))
                begin = i + 1
            i += 1
        return [*out, (begin, end - 1)] if begin < end else out

    def around(self, i: int) -> Iterator[int]:
        """Opening brackets around a token, the nearest first."""
        i = self.parent[i]
        while i >= 0:
            yield i
            i = self.parent[i]

    def called(self, opening: int) -> str:
        """The name before a round bracket, through type arguments."""
        i = opening - 1
        name = self.word(i)
        if name == ">":
            while i >= 0 and self.text[i] != "<":
                i -= 1
            name = self.word(i - 1)
        return name if WORD.match(name) else ""

    @cached_property
    def named(self) -> dict[int, tuple[str, int]]:
        """Bodies (opening braces or arrow brackets) of named functions, methods and arrow-assigned variables."""
        out: dict[int, tuple[str, int]] = {}
        for i in self.rounds:
            brace = self.pair[i] + 1
            if self.word(brace) == ":":
                while brace < len(self.text) and self.text[brace] not in ("{", "=>", ";"):
                    brace += 1
            name = self.called(i)
            if self.word(brace) == "{" and name and name not in ("if", "for", "while", "switch", "catch", "function", "return"):
                out[brace] = (name, i)
            elif self.word(brace) == "=>" or self.word(i - 1) == "function":
                k = i - 1 - (self.word(i - 1) == "function")
                k -= self.word(k) == "async"
                if self.word(k) == "=":
                    j = k - 1
                    while j > 0 and self.text[j] not in ("const", "let", "var", ";", "{", "}"):
                        j -= 1
                    opening = brace + 1 if self.word(brace) == "=>" else brace
                    if self.text[j] in ("const", "let", "var"):
                        out[opening if self.word(opening) in ("{", "(") else -opening - 1] = (self.text[j + 1], j)
        return out

    def owner(self, i: int) -> tuple[str, int]:
        for b in self.around(i):
            if b in self.named:
                return self.named[b][0], self.line(self.named[b][1])
        return "<module>", self.line(i)

    def scope(self, i: int) -> tuple[int, int]:
        """The function body around a token."""
        for b in self.around(i):
            if self.text[b] == "{" and (self.word(b - 1) in (")", "=>") or b in self.named) and self.called(self.pair.get(b - 1, b)) not in ("if", "for", "while", "switch", "catch"):
                return b, self.close(b)
        return 0, len(self.text) - 1

    def chain(self, i: int, closing: int) -> tuple[int, int, list[tuple[str, int]]]:
        """The fluent chain around a call: first token, last token, and (method, bracket) of what follows."""
        begin = i
        while self.word(begin - 1) in (".", "?.") or self.word(begin - 1) == "await":
            begin -= 1 if self.word(begin - 1) == "await" else 2
        links, end = [], closing
        while self.word(end + 1) in (".", "?.") and self.word(end + 3) == "(":
            links.append((self.word(end + 2), end + 3))
            end = self.close(end + 3)
        return begin, end, links

    def url(self, a: int, b: int) -> tuple[str, str]:
        """(URL, confidence) of an argument."""
        first = self.word(a)
        if a == b and first[:1] in "'\"":
            return first[1:-1], "certain"
        if a == b and first[:1] == "`":
            return "".join(":param" if p is None else p for p in template_parts(first, 0)[0]), "probable"
        if any(self.text[k] == "+" for k in range(a, b + 1)):
            pieces, k = [], a
            while k <= b:
                nxt = k
                while nxt <= b and self.text[nxt] != "+":
                    nxt = self.close(nxt) + 1 if self.text[nxt] in "([{" else nxt + 1
                pieces.append(self.text[k][1:-1] if nxt == k + 1 and self.text[k][0] in "'\"`" else ":param")
                k = nxt + 1
            return "".join(pieces), "probable"
        return "<dynamic>", "inferred"

    def keys(self, opening: int) -> tuple[list[str], bool]:
        """Keys of an object literal or pattern, and whether they are all (no spread)."""
        names = [self.word(a) for a, _ in self.arguments(opening)]
        return [n.strip("'\"") for n in names if n not in ("...", "[")], "..." not in names and "[" not in names

    def reads(self, a: int, b: int, path: list[str]) -> set[str]:
        """Fields read off a dotted name between two tokens, and those taken by a pattern from it."""
        out, n = set(), len(path) * 2 - 1
        spelled = ".".join(path).replace(".", " . ").split()
        for i in range(a, b - n + 1):
            if self.text[i : i + n] != spelled or self.word(i - 1) in (".", "?."):
                continue
            if self.word(i + n) in (".", "?.") and WORD.match(self.word(i + n + 1)):
                out.add(self.word(i + n + 1))
            if self.word(i - 1) == "=" and self.word(i - 2) == "}" and self.word(i + n) not in (".", "?.", "("):
                out |= set(self.keys(self.pair.get(i - 2, i - 2))[0])
        return out - BUILTINS


def _parameter(s: Script, a: int) -> tuple[str, int]:
    """(name, index of a pattern's brace or -1) of an arrow function's first parameter."""
    i = a + (s.word(a) == "async")
    i += s.word(i) == "("
    return (s.word(i), -1) if WORD.match(s.word(i)) else ("", i if s.word(i) == "{" else -1)


def expected(s: Script, i: int, opening: int, axios: bool) -> list[str]:
    """Fields that are read off a call's response, by the usual shapes only."""
    begin, _, links = s.chain(i, s.close(opening))
    a, b = s.scope(i)
    out: set[str] = set()
    lead = begin - 1
    bound = s.word(lead - 1) if s.word(lead) == "=" and s.word(begin) == "await" else ""
    if WORD.match(bound or "!"):
        if axios:
            out |= s.reads(a, b, [bound, "data"])
        else:
            for k in range(a, b - 6):
                if s.text[k : k + 6] == ["=", "await", bound, ".", "json", "("] and WORD.match(s.word(k - 1)):
                    out |= s.reads(a, b, [s.word(k - 1)])
    elif bound == "}" and axios and s.word(begin) == "await":
        pass
    if axios and s.word(begin) == "await" and s.word(lead) == "(":
        out |= _inline(s, s.close(lead))
    calls = [(n, br) for n, br in links if n == "then"]
    for k, (_, br) in enumerate(calls):
        name, pattern = _parameter(s, br + 1)
        end = s.close(br)
        if axios:
            if name and not k:
                out |= s.reads(br, end, [name, "data"])
            break
        if name and s.span(br + 1, end - 1).replace(" ", "").rstrip("()").endswith(f"=>{name}.json") and k + 1 < len(calls):
            nxt = calls[k + 1][1]
            inner, pattern = _parameter(s, nxt + 1)
            if inner:
                out |= s.reads(nxt, s.close(nxt), [inner])
            elif pattern >= 0:
                out |= set(s.keys(pattern)[0]) - BUILTINS
            break
    return sorted(out)


def _inline(s: Script, closing: int) -> set[str]:
    """(await call).data.field, or a pattern taken from (await call).data."""
    if s.word(closing + 1) != "." or s.word(closing + 2) != "data":
        return set()
    if s.word(closing + 3) == "." and WORD.match(s.word(closing + 4)):
        return {s.word(closing + 4)} - BUILTINS
    begin = s.pair.get(closing, closing)
    if s.word(begin - 1) == "=" and s.word(begin - 2) == "}":
        return set(s.keys(s.pair[begin - 2])[0]) - BUILTINS
    return set()


def sent(s: Script, args: list[tuple[int, int]], axios: bool, method: str) -> tuple[list[str] | None, bool]:
    """(fields, complete) of a request body that is an object literal."""
    if method not in BODY_METHODS or len(args) < 2:
        return None, False
    a, b = args[1]
    if axios:
        return s.keys(a) if s.word(a) == "{" else (None, False)
    for k in range(a, b - 3):
        if s.text[k : k + 4] == ["JSON", ".", "stringify", "("] and s.word(k + 4) == "{":
            return s.keys(k + 4)
    return None, False


def _features(s: Script, i: int, opening: int) -> tuple[bool, bool, str]:
    begin, end, links = s.chain(i, s.close(opening))
    text = s.span(begin, end)
    tried = any(s.text[b] == "{" and s.word(b - 1) == "try" for b in s.around(i))
    hook = next((b for b in s.around(i) if s.text[b] == "(" and s.called(b) in HOOKS), None)
    typed = _type_argument(s, hook) if hook is not None else ""
    return tried or hook is not None or any(n == "catch" for n, _ in links), any(w in text for w in ("AbortController", "signal", "timeout")), typed


def _type_argument(s: Script, opening: int) -> str:
    return s.word(opening - 2) if s.word(opening - 1) == ">" and s.word(opening - 3) == "<" and WORD.match(s.word(opening - 2)) else ""


def call_sites(s: Script) -> Iterator[Fact]:
    for opening in [i for i, t in enumerate(s.text) if t == "(" or t[0] == "`"]:
        t = s.text[opening]
        if t != "(" and s.word(opening - 1) in ("gql", "graphql"):
            found = document_fields(re.sub(r"\$\{[^}]*\}", "", t[1:-1]))
            name, line = s.owner(opening)
            for f in found[1] if found else []:
                yield "call", {"method": found[0], "url": f"/graphql#{f}", "confidence": "certain", "line": s.line(opening - 1), "component": name, "component_line": line, "has_error_handling": True, "has_timeout": True, "graphql": True}
        if t != "(" or opening not in s.pair:
            continue
        i = opening - 1
        typed = _type_argument(s, opening)
        i -= 3 if typed else 0
        name = s.word(i)
        dotted = s.word(i - 1) in (".", "?.")
        if not dotted and name != "fetch" or not WORD.match(name):
            continue
        fact: dict | None = None
        args = s.arguments(opening)
        owner_name = s.word(i - 2) if dotted else ""
        path, k = [name], i
        while s.word(k - 1) in (".", "?.") and WORD.match(s.word(k - 2)):
            path.insert(0, s.word(k - 2))
            k -= 2
        if name == "fetch" and not dotted and args:
            options = s.span(*args[1]) if len(args) > 1 and s.word(args[1][0]) == "{" else ""
            found = re.search(r"method\s*:\s*['\"`](\w+)", options, re.I)
            fact = {"method": found[1].upper() if found else "GET"}
        elif len(path) > 2 and path[0].lower() in TRPC_ROOTS and name in TRPC_VERBS:
            who, line = s.owner(i)
            yield "call", {"method": TRPC_VERBS[name], "url": "/trpc#" + ".".join(path[1:-1]), "confidence": "certain", "line": s.line(k), "component": who, "component_line": line, "has_error_handling": True, "has_timeout": True, "trpc": True}
            continue
        elif dotted and name in VERBS and CLIENT.match(owner_name) and args:
            fact = {"method": name.upper()}
        elif dotted and OWN_CLIENT.match(owner_name) and name not in BUILTINS and name not in VERBS and len(path) == 2:
            fact = {"operation_id": name, "url": "", "method": "", "confidence": "probable"}
        if fact is None:
            continue
        axios = dotted
        if "url" not in fact:
            url, confidence = s.url(*args[0])
            fact |= {"url": re.sub(r"^https?://[^/]+", "", url) or "/" if url != "<dynamic>" else url, "confidence": confidence}
            if fact["url"] != "<dynamic>" and not fact["url"].startswith(("/", ":")):
                fact["url"] = "/" + fact["url"]
        handled, timed, hook_type = _features(s, k, opening)
        who, line = s.owner(i)
        body, complete = sent(s, args, axios, fact["method"])
        yield "call", fact | {"line": s.line(k), "component": who, "component_line": line, "has_error_handling": handled, "has_timeout": timed, "expected_fields": expected(s, k, opening, axios) or None, "response_type": typed or hook_type or None, "sent_fields": body, "sent_complete": complete}


def types(s: Script) -> Iterator[Fact]:
    """Shapes of interfaces and object types."""
    for i in [i for i, t in enumerate(s.text) if t in ("interface", "type")]:
        t = s.text[i]
        if not WORD.match(s.word(i + 1)):
            continue
        b = i + 2
        while t == "interface" and b < len(s.text) and s.text[b] != "{":
            b += 1
        b += t == "type" and s.word(b) == "="
        if s.word(b) != "{" or b not in s.pair:
            continue
        required, optional, k = [], [], b + 1
        while k < s.pair[b]:
            if WORD.match(s.word(k)) and s.word(k + 1) in (":", "?"):
                (optional if s.word(k + 1) == "?" else required).append(s.word(k))
                while k < s.pair[b] and s.text[k] not in (";", ",") and (s.line(k) == s.line(k - 1) or s.text[k - 1] not in ("}", "]", ")", ">") and not (WORD.match(s.word(k)) and s.word(k + 1) in (":", "?") and k > b + 1 and s.word(k - 1) not in ("|", ":", "&", ",", ";", "{"))) or s.text[k] in ("|", "&", ":"):
                    k = s.close(k) + 1 if s.text[k] in "([{" else k + 1
                    if k < s.pair[b] and s.line(k) != s.line(k - 1) and WORD.match(s.word(k)) and s.word(k + 1) in (":", "?"):
                        break
            else:
                k += 1
        yield "type", {"name": s.word(i + 1), "required": required, "optional": optional}


def express(s: Script) -> Iterator[Fact]:
    """Routers, routes with their middleware, mounts, exports and requires of a file that uses Express."""
    if not re.search(r"(require\(\s*['\"]express['\"]\s*\)|from\s+['\"]express['\"])", s.source):
        return
    routers, authed = set(), set()
    for i in range(len(s.text)):
        if s.word(i + 1) == "=" and (s.text[i + 2 : i + 4] == ["express", "("] or s.text[i + 2 : i + 6] == ["express", ".", "Router", "("] or s.text[i + 2 : i + 4] == ["Router", "("]):
            routers.add(s.text[i])
        if s.text[i + 1 : i + 4] == ["=", "require", "("] and s.word(i + 4)[:1] in "'\"":
            yield "require", {"local": s.text[i], "spec": s.word(i + 4)[1:-1]}
        if s.text[i] == "import" and s.word(i + 2) == "from":
            yield "require", {"local": s.word(i + 1), "spec": s.word(i + 3)[1:-1]}
        if s.text[i : i + 4] == ["module", ".", "exports", "="] or s.text[i : i + 2] == ["export", "default"]:
            yield "export", {"local": s.word(i + 4) if s.text[i] == "module" else s.word(i + 2)}
    routes = []
    for opening, t in enumerate(s.text):
        if t != "(" or s.word(opening - 2) != "." or s.word(opening - 3) not in routers:
            continue
        name, router, args = s.word(opening - 1), s.word(opening - 3), s.arguments(opening)
        literal = s.word(args[0][0])[1:-1] if args and args[0][0] == args[0][1] and s.word(args[0][0])[:1] in "'\"" else None
        words = [s.text[k] for a, b in args[1:-1] for k in range(a, b + 1) if WORD.match(s.text[k])]
        if name == "use":
            used = [s.text[k] for a, b in args for k in range(a, b + 1) if WORD.match(s.text[k])]
            if literal is not None and len(args) > 1 and WORD.match(s.word(args[-1][0])):
                yield "mount", {"router": router, "prefix": literal, "target": s.word(args[-1][0])}
            if any(AUTH.search(w) for w in used) and literal is None:
                authed.add(router)
        elif name in VERBS and literal is not None and len(args) > 1:
            routes.append({"router": router, "method": name.upper(), "path": literal, "line": s.line(opening - 3), "has_auth": any(AUTH.search(w) for w in words)})
    for r in routes:
        yield "express_route", r | {"has_auth": r["has_auth"] or r["router"] in authed}


def file_routes(s: Script, kind: str) -> Iterator[Fact]:
    """Methods that a file under pages/api or app/api serves."""
    if kind == "pages":
        found = re.findall(r"method\s*={2,3}\s*['\"](\w+)['\"]|case\s+['\"](GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)['\"]", s.code())
        methods = sorted({(a or b).upper() for a, b in found}) or ["GET"]
    else:
        methods = sorted({m for m in re.findall(r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b", s.code())})
    for m in methods:
        yield "file_route", {"method": m}


def trpc(s: Script) -> Iterator[Fact]:
    """Entries of router objects: procedures with their verb, and nested routers by name."""
    for opening, t in enumerate(s.text):
        if t != "(" or s.called(opening) not in ("router", "createTRPCRouter", "mergeRouters") or s.word(opening + 1) != "{":
            continue
        k = opening - 2
        while k >= 0 and s.text[k] in (".",) or WORD.match(s.word(k)) and s.word(k + 1) == ".":
            k -= 1
        if s.word(k) != "=":
            continue
        name = s.word(k - 1)
        exported = s.word(k - 3) == "export" or f"export {name}" in s.source
        for a, b in s.arguments(opening + 1):
            body = s.text[a + 2 : b + 1]
            verb = next((v.upper() for v in ("query", "mutation", "subscription") if any(body[i] == v and body[i - 1] == "." and i + 1 < len(body) and body[i + 1] == "(" for i in range(1, len(body)))), None)
            if verb:
                yield "procedure", {"router": name, "key": s.word(a), "verb": verb, "nested": None, "exported": exported, "line": s.line(a)}
            elif a == b or b == a + 2:
                yield "procedure", {"router": name, "key": s.word(a), "verb": None, "nested": s.word(b), "exported": exported, "line": s.line(a)}
