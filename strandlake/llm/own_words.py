"""An author's own words in a forum post: no quotes, signatures, markup, links, code or pasted data."""

from __future__ import annotations

import html
import re
from collections import Counter

#: Tags and attributions hold no bracket of their own kind and no line break, so that a search ends at the next one.
_BLOCK = re.compile(r"\[(/?)(quote)\b[^\[\]\n]*\]|<(/?)(blockquote)\b[^<>\n]*>", re.I)
_QUOTED_LINE = re.compile(r"\s*[>|]")
_ATTRIBUTION = re.compile(r"\s*(?:on [^\n]*, *)?[^\s,]+ (?:wrote|said|writes) ?:?\s*$", re.I)
_ATTRIBUTION_ENDS = tuple(":eEdDsS")
_FRAME_HEAD, _FRAME = re.compile(r"\s*quote from:? ", re.I), re.compile(r"\s*-{5,}\s*$")
_CODE_OPEN = re.compile(r"\[code\b[^\[\]\n]*\]|<(?:pre|code)\b[^<>\n]*>|^[^\S\n]*```", re.I | re.M)
_CODE_CLOSE = re.compile(r"\[/code\]|</(?:pre|code)>|^[^\S\n]*```", re.I | re.M)
#: Code opened on a quoted line is part of the quote and may be cut off with it: then quotes go first.
_CODE_IN_QUOTE = re.compile(r"^[^\S\n]*[>|][^\n]*(?:\[code\b|<(?:pre|code)\b|```)", re.I | re.M)
#: One of these is in every code block.
_CODE_MARKS = ("[code", "<code", "<pre", "```")
_SIGN = re.compile(r"(?:--\s*|_{5,}\s*|~ .+ ~\s*)$")
#: The delimiter of signatures, at any distance from the end.
_DELIMITER = "-- "
#: After any other mark a signature has at most this many lines, by default; such a mark higher up is only a separator.
SIGN_LINES = 8
_SIG_OPEN, _SIG_CLOSE = re.compile(r"\[sig\b[^\[\]\n]*\]", re.I), re.compile(r"\[/sig\]", re.I)
_EDITED = re.compile(r"\[size=\d+\]\s*edited[^\[\n]*\[/size\]", re.I)
_TAG = re.compile(r"\[/?[a-z*]+(?:=[^\[\]\n]*)?\]|</?[a-z][a-z0-9]*\b[^<>\n]*>", re.I)
_BREAK = re.compile(r"<(?:br|/p|/div|/li)\s*/?>", re.I)
#: Ends of names that are links without a scheme or a path.
_ENDS = ("example", "com", "org", "net", "edu", "gov", "info", "io")
#: A scheme or 'www.', a dotted name with a path, or one with a common end; dotted names are tried from their start only.
_LINK = re.compile(rf"(?:https?://|ftp://|www\.)\S+|(?<![\w.-])[\w.-]+\.(?:[a-z]{{2,}}/\S*|(?:{'|'.join(_ENDS)})\b\S*)", re.I)
#: One of these is in every link.
_LINK_MARKS = ("/", "www.", *(f".{e}" for e in _ENDS))
_PLACEHOLDER = re.compile(r"\W*(?:(?:post|message|comment) )?(?:deleted|removed)(?: by (?:the )?(?:author|moderator|user))?\W*$", re.I)
_DIGIT, _NO_LETTERS = re.compile(r"\d"), re.compile(r"[\W\d_]*$")
_BASES, _MAY_BASES = re.compile(r"\b[ACGTUNacgtun]{12,}\b"), re.compile("[ACGTUNacgtun]{12}")
_ZERO_WIDTH = re.compile("[\u200b\u200c\u200d\ufeff\xad]")


def _without_code(text: str) -> str:
    out, at = [], 0
    while m := _CODE_OPEN.search(text, at):
        out.append(text[at : m.start()])
        end = _CODE_CLOSE.search(text, m.end())
        at = end.end() if end else len(text)
    return "\n".join([*out, text[at:]])


def _next_closes(tags: list[tuple[str, bool]]) -> list[dict[str, bool]]:
    """For each place in a list of tags and each kind, whether the next tag of that kind is a closing one."""
    out, now = [{}] * (len(tags) + 1), {}
    for i in range(len(tags) - 1, -1, -1):
        kind, closes = tags[i]
        if now.get(kind) != closes:
            now = now | {kind: closes}
        out[i] = now
    return out


def _without_quotes(text: str) -> str:
    """Drop quoted lines, framed quotes and what lies in quote tags.

    A tag opened on a quoted line belongs to that quote and ends with it, as
    quotes are often cut off; elsewhere a closing tag ends all opened since its
    own. Where tags of a kind don't pair up, the cut has taken inner closing
    tags, so a closing tag that no other one follows at once ends them all.
    """
    low = text.lower()
    if ">" not in text and "|" not in text and "quote" not in low:
        return text
    lines = text.split("\n")
    quoted_at = [bool(_QUOTED_LINE.match(line)) for line in lines]
    tags = [] if "[" not in text and "<" not in text else [((m.group(2) or m.group(4)).lower(), bool(m.group(1) or m.group(3))) for line, q in zip(lines, quoted_at) if not q for m in _BLOCK.finditer(line)]
    opened, closed = Counter(k for k, c in tags if not c), Counter(k for k, c in tags if c)
    closes_next = _next_closes(tags)
    frames = "quote from" in low
    seen = 0
    out: list[str] = []
    stack: list[str] = []
    depth: Counter = Counter()  # kinds on the stack
    inner: list[str] = []
    within_inner: Counter = Counter()
    i = 0
    while i < len(lines):
        line = lines[i]
        if frames and not stack and i + 1 < len(lines) and _FRAME_HEAD.match(line) and _FRAME.match(lines[i + 1]):
            end = next((j for j in range(i + 2, len(lines)) if _FRAME.match(lines[j])), None)
            i = len(lines) if end is None else end + 1
            continue
        quoted, within = quoted_at[i], bool(stack)
        if not quoted and inner:
            inner, within_inner = [], Counter()
        kept, at = [], 0
        for m in _BLOCK.finditer(line) if "[" in line or "<" in line else ():
            if not quoted and not stack:
                kept.append(line[at : m.start()])
            at = m.end()
            closes, kind = m.group(1) or m.group(3), (m.group(2) or m.group(4)).lower()
            seen += not quoted
            if not closes:
                (inner if quoted else stack).append(kind)
                (within_inner if quoted else depth)[kind] += 1
            elif within_inner[kind]:
                _pop(inner, within_inner, kind)
            elif depth[kind]:
                _pop(stack, depth, kind)
                if opened[kind] != closed[kind] and not closes_next[seen].get(kind, False):
                    while depth[kind]:
                        _pop(stack, depth, kind)
        if not stack and (not quoted or within):  # a quote may end on a quoted line
            kept.append(line[at:])
        rest = " ".join(kept)
        may = rest and rest.rstrip()[-1:] in _ATTRIBUTION_ENDS
        follows = next((x for x in lines[i + 1 : i + 3] if x.strip()), "") if may else ""
        if not (may and _ATTRIBUTION.match(rest) and (_QUOTED_LINE.match(follows) or _BLOCK.match(follows.lstrip()))):
            out.append(rest)
        i += 1
    return "\n".join(out)


def _pop(stack: list[str], depth: Counter, kind: str) -> None:
    """Take tags off the stack up to and with the last one of a kind."""
    while (last := stack.pop()) != kind:
        depth[last] -= 1
    depth[kind] -= 1


def _without_signature(text: str, sign_lines: int) -> str:
    if "[" in text:
        out, at = [], 0
        while (m := _SIG_OPEN.search(text, at)) and (end := _SIG_CLOSE.search(text, m.end())):
            out.append(text[at : m.start()])
            at = end.end()
        text = "\n".join([*out, text[at:]])
    text = text.rstrip()
    lines = text.split("\n")
    near = len(lines) - sign_lines - 1
    first = lines.index(_DELIMITER) if _DELIMITER in lines else len(lines)
    for i in range(max(near, 0), first):
        if lines[i][:1] in "-_~" and _SIGN.match(lines[i]):
            first = i
            break
    return text if first == len(lines) else "\n".join(lines[:first])


def _is_data(line: str) -> bool:
    """A line of pasted numbers or columns rather than prose."""
    if line.count("\t") >= 2:
        return True
    if not _DIGIT.search(line):
        return False
    letters, digits = sum(map(str.isalpha, line)), sum(map(str.isdigit, line))
    return letters + digits > 0 and digits > letters


def own_words(text: str | None, sign_lines: int = SIGN_LINES) -> str:
    """The post's own prose, by lines; '' if there is none.

    ``sign_lines``: most lines of a signature after a mark other than '-- ',
    which begins one of any length.
    """
    if not text or not text.strip():
        return ""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = _ZERO_WIDTH.sub("", text)
    low = text.lower()
    if not any(mark in low for mark in _CODE_MARKS):
        text = _without_quotes(text)
    elif _CODE_IN_QUOTE.search(text):
        text = _without_code(_without_quotes(text))
    else:
        text = _without_quotes(_without_code(text))
    text = _without_signature(text, sign_lines)
    if "[" in text or "<" in text:
        text = _TAG.sub(" ", _BREAK.sub("\n", _EDITED.sub(" ", text)))
    if "&" in text:
        text = html.unescape(text)
    text = text.replace("\xa0", " ")
    low = text.lower()
    if any(mark in low for mark in _LINK_MARKS):
        text = _LINK.sub(" ", text)
    if _MAY_BASES.search(text):
        text = _BASES.sub(" ", text)
    lines = [line.strip() for line in text.split("\n")]
    return "\n".join(line for line in lines if not _NO_LETTERS.match(line) and not _is_data(line) and not _PLACEHOLDER.match(line))
