"""Pages to text blocks, by the structure of their markup."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Content of these is never text of the page.
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "map", "datalist"}
#: Menus, headers, footers, sidebars, notices, forms.
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog", "fieldset", "input", "label", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end a block of text.
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Words of a class, id or role that name what is not the article.
_OUTSIDE = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav\w*|menu|breadcrumbs?|sidebar|"
    r"aside|widget|related|recommend\w*|comments?|commentlist|replies|reply|respond|disqus|share|sharing|social|footer|foot|masthead|skip|toolbar|pagination|pager|tags|"
    r"search|complementary|contentinfo|navigation|advertisement|dialog|hidden"
)
OUTSIDE = re.compile(rf"(?:^|[\s_-])(?:{_OUTSIDE})(?:$|[\s_-])", re.IGNORECASE)
#: An ``article`` element is the article whatever its classes say, but for these.
NOT_AN_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|related|promo\w*|sponsor\w*|ads?|teaser)(?:$|[\s_-])", re.IGNORECASE)
#: An open element of the left kind ends where one of the right kind begins.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
WHITE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Blocks in page order: ``(zone, text)`` with the zones article, main (but no article), open and furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, furniture, 2 in an article, 1 in main
        self.out: list[tuple[str, str]] = []
        self.silent = 0  # open elements without text
        self.text: list[str] = []

    def _state(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0)

    def flush(self) -> None:
        if self.text:
            if text := WHITE.sub(" ", "".join(self.text)).strip():
                outside, article = self._state()
                self.out.append(("furniture" if outside else ("open", "main", "article")[article], text))
            self.text = []

    def handle_starttag(self, tag, attrs):
        while self.stack and tag in ENDS.get(self.stack[-1][0], ()):
            self.flush()
            self.stack.pop()
        if tag in BLOCK:
            # an inline element that was never closed ends with its paragraph
            at = max((i for i, x in enumerate(self.stack) if x[0] == "p"), default=None)
            if at is not None and tag in ENDS["p"] and all(x[0] not in BLOCK and not x[1] for x in self.stack[at + 1 :]):
                self.flush()
                del self.stack[at:]
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        out, article = self._state()
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v) for k, v in attrs)
        roles = {v for k, v in attrs if k == "role"}
        is_article = 2 if tag == "article" or "article" in roles else 1 if tag == "main" or "main" in roles else 0
        outside = bool((NOT_AN_ARTICLE if tag == "article" else OUTSIDE).search(names)) and tag not in ("html", "body", "main")
        header = tag == "header" and not article
        begins = tag in FURNITURE or header or hidden or outside
        if begins and not out:
            self.flush()
        self.silent += tag in SILENT
        self.stack.append((tag, out or begins, max(article, is_article)))

    def handle_endtag(self, tag):
        at = max((i for i, x in enumerate(self.stack) if x[0] == tag), default=None)
        if at is None:
            return
        # a stray end tag does not close the blocks around it
        if tag not in BLOCK and any(x[0] in BLOCK for x in self.stack[at + 1 :]):
            return
        if tag in BLOCK or self.stack[at][1]:
            self.flush()
        self.silent -= sum(x[0] in SILENT for x in self.stack[at:])
        del self.stack[at:]

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def blocks(html: str | None) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out
