"""Text as a reader sees it: escapes, markup, invisible characters and Unicode forms resolved.

Each step runs only on texts that hold its trigger, so plain text costs a few substring searches.
"""

from __future__ import annotations

import html
import re
import unicodedata

# fixed values: names of HTML elements whose tags don't separate words, and of those that do
INLINE = "a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr"
BLOCK = (
    "address article aside audio blockquote body br button canvas caption center col colgroup dd details dialog div dl dt embed fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html iframe img input label legend li link main map meta nav noscript object ol optgroup option p "
    "param picture pre progress ruby script section select source style summary svg table tbody td template textarea tfoot th thead time title tr track ul video"
)
# a tag with a value (an image may hold a file) has any length; a stretch without one is soon no tag but a comparison
_INLINE = re.compile(rf"</?(?:{'|'.join(INLINE.split())})(?:\s[^<>]{{0,400}}|\s[^<>=]*=[^<>]*)?/?>", re.I)
_BLOCK = re.compile(rf"</?(?:{'|'.join(BLOCK.split())})(?:\s[^<>]{{0,2000}}|\s[^<>=]*=[^<>]*)?/?>", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!doctype[^<>]*>", re.S | re.I)
_ANSI = re.compile("\x1b\\[[0-9;?]*[ -/]*[@-~]|\x1b[()][0-9A-B]")
_LATEX = re.compile(r"\\+(?:textbf|textit|textsc|texttt|emph|underline|text|mathrm|mathbf|mathit)\s*\{")
_ESCAPE = re.compile(r"\\+(?:u[dD][89abAB][0-9a-fA-F]{2}\\+u[dD][c-fC-F][0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|[nrtbfv])")
_LINK = re.compile(r"\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)")
#: Invisible: format characters and variation selectors, except those that are digits of other scripts.
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]")
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf]{1,3}")


def _escaped(m: re.Match) -> str:
    s = m[0].lstrip("\\")
    if s[0] in "nrtbfv":
        return " "
    if s[0] in "uU" and len(s) > 9:
        high, low = int(s[1:5], 16), int(s[-4:], 16)
        return chr(0x10000 + ((high - 0xD800) << 10) + (low - 0xDC00))
    code = int(s[1:], 16)
    return " " if 0xD800 <= code < 0xE000 or code > 0x10FFFF or code < 32 and code != 27 else chr(code)


def _reread(m: re.Match) -> str:
    try:
        return m[0].encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def visible(text: str) -> str:
    """The words of a text as they read, in compatibility form and without case."""
    if "\\" in text:
        text = _ESCAPE.sub(_escaped, _LATEX.sub(" ", text))
    if "\x1b" in text:
        text = _ANSI.sub("", text)
    if "<" in text:
        text = _BLOCK.sub(" ", _INLINE.sub("", _COMMENT.sub(" ", text) if "<!" in text else text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if not text.isascii():
        if _MISREAD.search(text):
            text = _MISREAD.sub(_reread, text)
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKC", text)
        text = _MARKS.sub("", text).casefold()
    return text
