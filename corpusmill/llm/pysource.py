"""A lexer for Python source that finds functions and their documentation.

It is a state machine over the tokens that can change the lexical state:
string literals (with prefixes, triple quotes and nested f-string fields),
comments, brackets, line joins and line ends.  Brackets are matched to tell
logical lines from physical ones; indentation of logical lines delimits
definitions.  Syntax trees are only built to tell whether a text is Python and
whether a comment is commented-out code.
"""

from __future__ import annotations

import ast
import re
import symtable
import textwrap
import unicodedata
import warnings
from typing import NamedTuple

_TOKEN = re.compile(
    r"""
    \#[^\n\r]*
  | (?:
        \"\"\"[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*\"\"\"
      | '''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''
      | "(?!"")[^"\\\n\r]*(?:\\(?:\r\n|.)[^"\\\n\r]*)*"
      | '(?!'')[^'\\\n\r]*(?:\\(?:\r\n|.)[^'\\\n\r]*)*'
    )
  | (?P<f>(?<!\w)[rR]?[fFtT][rR]?(?:\"\"\"|'''|"|'))
  | [(\[{]
  | [)\]}]
  | \\\r?\n | \\\r
  | \r\n?|\n
  | :
    """,
    re.X | re.S,
)
_DEF = re.compile(r"(?:(?P<def>(?:async(?:[ \t\f]|\\\r?\n)+)?def)|class)(?:[ \t\f]|\\\r?\n)+(?P<name>\w+)")
_INDENT = re.compile(r"[ \t\f]*")
_LINE = re.compile(r"[^\r\n]*")
_STRING = re.compile(
    r"""(?P<prefix>[A-Za-z]{0,2})(?:
        \"\"\"[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*\"\"\"
      | '''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''
      | "(?!"")[^"\\\n\r]*(?:\\(?:\r\n|.)[^"\\\n\r]*)*"
      | '(?!'')[^'\\\n\r]*(?:\\(?:\r\n|.)[^'\\\n\r]*)*'
    )""",
    re.X | re.S,
)
_BLANKS = re.compile(r"(?:[ \t\f]|\\\r\n|\\[\n\r])*")
_BLANKS_IN_PARENS = re.compile(r"(?:[ \t\f\n\r]|\\|\#[^\n\r]*)*")
_STATEMENT_END = re.compile(r"[ \t\f]*(?:[;#\r\n]|\Z)")


class Function(NamedTuple):
    """A documented or undocumented function; spans are half-open, in code points."""

    qualname: str
    first: int
    last: int
    documentation: str | None
    origin: str | None


class _Scope:
    __slots__ = ("indent", "name", "is_def", "first", "start_line", "header_end", "doc", "origin", "body_seen", "last", "order")

    def __init__(self, indent: int, name: str, is_def: bool, first: int, start_line: int, order: int) -> None:
        self.indent, self.name, self.is_def, self.first, self.start_line, self.order = indent, name, is_def, first, start_line, order
        self.header_end = -1
        self.doc: str | None = None
        self.origin: str | None = None
        self.body_seen = False
        self.last = first


def _skip_fstring(s: str, pos: int, quote: str, raw: bool = False) -> int:
    """End of the f-string whose opening quote ends at pos; len(s) if unterminated."""
    n, single = len(s), quote[0]
    while pos < n:
        c = s[pos]
        if c == "\\":
            if not raw and s.startswith("N{", pos + 1):
                pos = s.find("}", pos) + 1 or n
            else:  # a brace keeps its meaning
                pos += 1 if s[pos + 1 : pos + 2] in ("{", "}") else 2
        elif c == single and s.startswith(quote, pos):
            return pos + len(quote)
        elif c == "{":
            if s.startswith("{{", pos):
                pos += 2
            else:
                pos = _skip_field(s, pos + 1)
        else:
            pos += 1
    return n


def _skip_field(s: str, pos: int) -> int:
    """End of the replacement field whose brace ends at pos."""
    depth, n = 0, len(s)
    while pos < n:
        c = s[pos]
        if c in "'\"":
            start = pos
            while start > 0 and s[start - 1].isalpha() and pos - start < 2:
                start -= 1
            quote = s[pos : pos + 3] if s.startswith(c * 3, pos) else c
            if any(x in "fFtT" for x in s[start:pos]):
                pos = _skip_fstring(s, pos + len(quote), quote, any(x in "rR" for x in s[start:pos]))
            else:
                m = _STRING.match(s, pos)
                pos = m.end() if m else pos + 1
        elif c == "#":
            pos = _LINE.match(s, pos).end()
        elif c in "([{":
            depth += 1
            pos += 1
        elif c in ")]":
            depth -= 1
            pos += 1
        elif c == "}":
            if depth == 0:
                return pos + 1
            depth -= 1
            pos += 1
        elif c == ":" and depth == 0:
            return _skip_format_spec(s, pos + 1)
        else:
            pos += 1
    return n


def _skip_format_spec(s: str, pos: int) -> int:
    n = len(s)
    while pos < n:
        c = s[pos]
        if c == "}":
            return pos + 1
        pos = _skip_field(s, pos + 1) if c == "{" else pos + 1
    return n


def _docstring(s: str, pos: int) -> str | None:
    """Value of the string statement at pos, or None if there is no such statement."""
    first = s[pos : pos + 1]
    if first not in "'\"(" and not (first in "rRuU" and first):
        return None
    parens, parts = 0, []
    while True:
        pos = (_BLANKS_IN_PARENS if parens else _BLANKS).match(s, pos).end()
        if s.startswith("(", pos) and not parts:
            parens += 1
            pos += 1
            continue
        m = _STRING.match(s, pos)
        if m:
            if set(m["prefix"]) - set("rRuU"):
                return None
            parts.append(m.group())
            pos = m.end()
            continue
        if s.startswith(")", pos) and parens and parts:
            parens -= 1
            pos += 1
            if parens:
                continue
        break
    if not parts or parens or not _STATEMENT_END.match(s, pos):
        return None
    try:
        return "".join(ast.literal_eval(p) for p in parts)
    except (SyntaxError, ValueError):
        return None


def _comments_below(s: str, pos: int) -> list[str]:
    """The block of comment lines that opens the body after the header line ending at pos."""
    out: list[str] = []
    n = len(s)
    while pos < n:
        stop = _LINE.match(s, pos).end()
        line = s[pos:stop].strip(" \t\f")
        if line.startswith("#"):
            out.append(line)
        elif line or out:
            break
        pos = stop + (2 if s.startswith("\r\n", stop) else 1)
    return out


def functions(s: str) -> list[Function]:
    """All functions and methods of a Python source text, in order of their definitions.

    The text must be valid Python; on other text the result is unspecified, but it
    never raises.  Documentation is the docstring, else the comment block directly
    above the definition or its decorators, else the comment block that opens the body.
    """
    if "def" not in s:
        return []
    found: list[tuple[int, Function]] = []
    stack: list[_Scope] = []
    n, pos, depth = len(s), 1 if s.startswith("\ufeff") else 0, 0
    in_line = False  # inside a logical line
    header: _Scope | None = None  # a definition whose colon has not come yet
    decorators = -1  # offset of the first of the decorators just seen
    notes: list[str] = []  # the comment lines directly above
    decorators_notes: list[str] = []
    line_end = 0
    order = 0

    def close(scope: _Scope) -> None:
        if scope.is_def:
            name = ".".join([x.name for x in stack] + [scope.name])
            found.append((scope.order, Function(name, scope.first, scope.last, scope.doc, scope.origin)))

    def body(scope: _Scope, at: int) -> None:
        """The first statement of a definition's body begins at `at`."""
        scope.body_seen = True
        if not scope.is_def:
            return
        doc = _docstring(s, at)
        if doc is not None:
            scope.doc, scope.origin = doc, "docstring"

    search = _TOKEN.search
    while pos <= n:
        if not in_line and depth == 0:
            # The start of a physical line outside brackets.
            start = pos
            pos = _INDENT.match(s, pos).end()
            if pos >= n:
                break
            c = s[pos]
            if c in "\r\n":
                pos += 2 if s.startswith("\r\n", pos) else 1
                notes = []
                continue
            if c == "#":
                m = _LINE.match(s, pos)
                notes.append(m[0].rstrip(" \t\f"))
                pos = m.end()
                pos += 2 if s.startswith("\r\n", pos) else 1
                continue
            in_line = True
            above, notes = notes, []
            lead = s[start:pos]
            indent = len(lead.rpartition("\f")[2].expandtabs(8)) if lead else 0
            while stack and stack[-1].indent >= indent:
                scope = stack.pop()
                scope.last = max(scope.last, line_end)
                close(scope)
            if stack and not stack[-1].body_seen:
                body(stack[-1], pos)
            if c == "@":
                if decorators < 0:
                    decorators, decorators_notes = pos, above
            else:
                m = _DEF.match(s, pos) if c in "adc" else None
                if m:
                    is_def = m["def"] is not None
                    name = m["name"] if m["name"].isascii() else unicodedata.normalize("NFKC", m["name"])
                    scope = _Scope(indent, name, is_def, decorators if decorators >= 0 else pos, start, order)
                    order += 1
                    if is_def:
                        held = above or (decorators_notes if decorators >= 0 else [])
                        if held:
                            scope.doc, scope.origin = "\n".join(held), "comment above"
                    header = scope
                    pos = m.end()
                decorators = -1
        m = search(s, pos)
        if m is None:
            break
        c = m.group()[0]
        pos = m.end()
        if c in "\r\n":
            if depth == 0:
                in_line = False
                line_end = m.start()
                if header is not None:  # no colon: not valid Python
                    header = None
                elif stack and stack[-1].header_end == -2:
                    scope = stack[-1]
                    scope.header_end = line_end
                    if scope.is_def and scope.doc is None:
                        held = _comments_below(s, pos)
                        if held:
                            scope.doc, scope.origin = "\n".join(held), "comment below"
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(depth - 1, 0)
        elif c == ":":
            if depth == 0 and header is not None:
                scope, header = header, None
                rest = _BLANKS.match(s, pos).end()
                stack.append(scope)
                if rest < n and s[rest] not in "\r\n#":
                    scope.header_end = rest
                    body(scope, rest)
                else:
                    scope.header_end = -2
        elif m["f"] is not None:
            quote = m["f"].lstrip("rRfFtT")
            pos = _skip_fstring(s, pos, quote, len(m["f"]) - len(quote) == 2)
    if in_line:
        line_end = len(s.rstrip("\r\n"))
    while stack:
        scope = stack.pop()
        scope.last = max(scope.last, line_end)
        close(scope)
    found.sort(key=lambda x: x[0])
    return [f for _, f in found]


def parses(s: str) -> bool:
    """Whether the text is valid Python 3.  Symbol tables are cheaper than syntax trees;
    what they refuse is parsed again, because they also refuse some texts that parse.
    One leading byte order mark is no part of the text, as in a file.  A text nested more deeply
    than Python's own parser goes doesn't parse."""
    s = s.removeprefix("\ufeff")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            symtable.symtable(s, "source", "exec")
            return True
        except (SyntaxError, ValueError, RecursionError):
            return _tree(s) is not None


def _tree(s: str) -> ast.Module | None:
    """The syntax tree, if the text parses."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(s)
    except (SyntaxError, ValueError, RecursionError):
        return None


# Directives that tools read from comments.
_DIRECTIVE = re.compile(
    r"(?i:noqa|nosec|nopep8|skipcq)\b|NOLINT|(?i:no[- ]?cover)\s*$|pragma:\s*\w|-\*-|noinspection\s+[A-Z]\w+"
    r"|(?:vim?:\s*\S*\s*)?(?:file)?(?:en)?coding[:=]\s*[-\w.]+\s*$|pyre-(?:ignore|fixme|strict|unsafe)\b|sourcery skip\b"
    r"|type:\s*(?:ignore\b|\([^)]*\)\s*->\s*\S|[A-Za-z_][\w.]*(?:\[.*\])?\s*(?:#.*)?$)"
    r"|(?:pylint|pyright|mypy|ruff|flake8|isort|pytype|cython|codespell|cspell|spellchecker|lint|bandit|doctest|yapf|fmt|black):\s*"
    r"(?:(?:disable|enable|skip|ignore|noqa|words?)(?:[-_=:,\s]|$)|(?:on|off|split|strict|basic|standard|[a-z]+(?:-[a-z]+)+)\s*(?:,|#|$)|[\w-]+\s*=\s*\S|[+-][A-Z])"
)
_COMMENT_DIRECTIVE = re.compile(r"#(?:(?:end)?region\b|!\s*/)")  # told from prose by the sign before it
_RULER = re.compile(r"[\W_]*")
_DOC = r"(?:docs?|docstrings?|documentation|descriptions?|explanations?|comments?)"
_THIS = r"(?:(?:of|for|to|in|on)\s+)?(?:this|the|that)\s+(?:function|method|class|one|routine|helper|code|thing)"
# What may follow a note without saying more.
_LATER = rf"(?:[\W_]+(?:here|later|on|soon|yet|now|so far|for now|please|pending|missing|todo|tbd|goes here|to come|coming|to follow|needed|required|{_THIS}|(?:(?:is|are|will|still|to)\s+)*(?:be\s+)?(?:added|written|done|completed|provided|missing|pending|needed)))*[\W_]*"
_MISSING_DOC = rf"(?:(?:add|write|insert|fill in|put|provide|needs?|missing|no|improve|complete|finish)\s+(?:\w+\s+){{0,3}}?{_DOC}|{_DOC}|placeholder(?:\s+(?:for\s+)?(?:the\s+)?(?:{_DOC}|text))?|undocumented|(?:not|never) (?:yet )?documented|to be (?:documented|described|written|done|completed|added)|lorem ipsum\b.*)"
# After a tag such as TODO, a sentence on what to document.
_TO_DOCUMENT = rf"(?:please\s+)?(?:(?:document|describe|explain)\b|(?:add|write|insert|fill in|put|provide|needs?|missing|no|improve|complete|finish)\s+(?:\w+\s+){{0,3}}?{_DOC}\b|(?:write|finish|fill)\s+(?:this|me|it)\b)(?:[^.!?]|[.!?](?=\w))*[\W_]*"
_PLACEHOLDER = re.compile(
    rf"[\W_]*(?:(?:todo|fixme|xxx|tbd|tba|tbc|wip|hack|n/?a)\b(?:[ \t]*\([^)\n]*\))?[\W_]*)*(?:{_MISSING_DOC}\b{_LATER})?"
    rf"|[\W_]*(?:(?:todo|fixme|xxx|tbd|tba|tbc|wip)\b(?:[ \t]*\([^)\n]*\))?[\W_]*)+{_TO_DOCUMENT}",
    re.I | re.S,
)
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e00-\u0e7f]")  # scripts without blanks: two characters count as a word
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_]+")
_ARTICLES = {"a", "an", "the"}
_CODE_SIGN = re.compile(r"[=()\[\]{}:.@]|^\s*(?:return|pass|raise|import|from|break|continue|del|assert|yield|if|for|while|else|try)\b")
_ABBREVIATION = re.compile(r"(?i)^\s*(?:e\.\s?g|i\.\s?e|cf|vs|etc|approx|resp)\.|\w\. +\w")


def _is_code(line: str) -> bool:
    """Whether a comment's text is a statement: it parses, and it isn't mere words."""
    text = line.strip()
    if not text or not _CODE_SIGN.search(text) or _ABBREVIATION.search(text):
        return False
    if re.fullmatch(r"\w+:\s*\S.*", text) and not re.search(r"[()=\[\]]", text):
        return False  # `Note: ...` parses as an annotation
    if re.fullmatch(r"(?:\w+\.)", text):
        return False
    for candidate in (text, text + "\n    pass" if text.endswith(":") else "", "try:\n    pass\n" + text + "\n    pass" if text.startswith("except") else "", "if x:\n    pass\n" + text + "\n    pass" if text.startswith(("else", "elif")) else ""):
        tree = _tree(candidate) if candidate else None
        if tree is not None:
            return bool(tree.body) and not all(
                isinstance(x, ast.Expr) and isinstance(x.value, (ast.Name, ast.Constant, ast.Tuple, ast.UnaryOp, ast.BinOp, ast.Compare)) for x in tree.body
            )
    return False


def clean_documentation(doc: str | None, origin: str | None) -> str:
    """The documentation's own text: comment signs, directives, rulers and commented-out code removed."""
    if doc is None:
        return ""
    lines = re.split(r"\r\n|\r|\n", doc)
    if origin == "docstring":
        kept = [x.strip() for x in lines]
        return "\n".join(kept).strip()
    kept = []
    for line in lines:
        text = re.sub(r"^#+[:!|]?[ \t]?", "", line.strip())
        if _RULER.fullmatch(text) or _DIRECTIVE.match(text.strip()) or _COMMENT_DIRECTIVE.match(line.strip()):
            continue
        kept.append(text)
    code = [_is_code(x) for x in kept]
    if code and all(code):
        return ""
    whole = "\n".join(kept)
    if any(code):
        if _tree(textwrap.dedent(whole)) is not None:
            return ""  # a block of code whose single lines don't all parse
        kept = [x for x, is_code in zip(kept, code) if not is_code]
    return "\n".join(x.strip() for x in kept).strip()


def is_trivial(name: str, text: str) -> bool:
    """Whether cleaned documentation says nothing: too short, a placeholder, or the name again."""
    words = [w.lower() for w in _WORD.findall(text)]
    if sum(max(1, len("".join(_UNSPACED.findall(w))) // 2) for w in words) < 4:
        return True
    if _PLACEHOLDER.fullmatch(text):
        return True
    if all(_RULER.fullmatch(x) or _DIRECTIVE.match(x.strip().lstrip("# ")) for x in text.split("\n")):
        return True
    own = {w.lower() for w in _CAMEL.findall(name)}
    said = {w for x in words for w in re.split(r"['’\-]", x)} - _ARTICLES
    return said <= own
