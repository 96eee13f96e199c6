"""HTML pages as tokens: tags with their place in the tree, and the strings between them."""

from __future__ import annotations

import re
from collections import namedtuple

import xxhash

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_DIGITS, _WORD = re.compile(r"\d{3,}"), re.compile(r"[A-Za-z][a-z]*")
_BROKEN = re.compile(r"<(?:[a-zA-Z/!?]|\Z)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in
       ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}
BLOCK = frozenset("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre
section select summary svg table tbody td template tfoot th thead title tr ul""".split())
ENDS_P = BLOCK - frozenset("button body head html noscript option optgroup svg td template th title tr tbody tfoot thead".split())
P, NOT_P = frozenset(("p",)), BLOCK - {"p"}
#: What an opening tag closes when it is open, and where the search for it stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Elements and class words that never hold the article, and those that do not unless an article is inside.
NEVER = frozenset("nav aside footer form button select menu dialog noscript template svg head".split())
NEVER_WORDS = frozenset("""ad ads adslot advert adverts advertisement advertising sponsor sponsored promo promotion comment
comments reply replies disqus respond footer related recommended recommendations breadcrumb breadcrumbs pagination
pager share sharing newsletter subscribe signup login cookie cookies consent gdpr copyright""".split())
SELDOM_WORDS = frozenset("""nav navbar navigation menu sidebar aside banner notice notices alert social widget
widgets toolbar search popup modal overlay""".split())
NEVER_ROLES = frozenset("navigation complementary contentinfo search form dialog alertdialog menu menubar".split())
SELDOM_ROLES = frozenset("banner alert status".split())
BODY_NAMES = frozenset(("article-body", "article-content", "article-text", "post-body", "post-content", "entry-content",
                        "story-body", "articlebody"))

HEADER_WORDS = frozenset(("header", "masthead"))
NEVER_HERE, SELDOM_HERE, LINK, HEADING, HEADER = 1, 2, 4, 8, 16
END = 0x5851F42D4C957F2D
#: A string: where it stands among the page's tokens, its hash, text, block, marks, level and the tag around it.
Text = namedtuple("Text", "at token text block marks level parent")


class Tags(dict):
    """(name, attributes as written) to (signature, marks, level); cleared when it grows large."""

    LIMIT = 1 << 15

    def __missing__(self, key: tuple[str, str]) -> tuple[str, int, int]:
        if len(self) > self.LIMIT:
            self.clear()
        name, rest = key
        has = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if rest else {}
        names = f"{has.get('class', '')} {has.get('id', '')}".split()
        words = {w.lower() for n in names for w in _WORD.findall(n)} if name not in ("html", "body") else set()
        role, marks, level = has.get("role", "").lower(), 0, 0
        if name in ("article",) or has.get("itemprop", "").lower() == "articlebody" or any(
                n.lower() in BODY_NAMES for n in names):
            level = 2
        elif name == "main" or role == "main":
            level = 1
        style = has.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in has or has.get("aria-hidden", "").lower() == "true" or "display:none" in style
        if name in NEVER or role in NEVER_ROLES or hidden or (words & NEVER_WORDS and name != "main"):
            marks |= NEVER_HERE
        elif role in SELDOM_ROLES or words & SELDOM_WORDS:
            marks |= SELDOM_HERE
        elif name == "header" or words & HEADER_WORDS:
            marks |= HEADER
        if name == "a":
            marks |= LINK
        if name in HEADINGS:
            marks |= HEADING
        shown = " ".join(sorted(_DIGITS.sub("0", n) for n in names))
        self[key] = made = f"{name} {shown} {role}", marks, level if not marks & NEVER_HERE else 0
        return made


class Parser:
    """Pages as tokens. One per worker: it remembers the tags it has seen."""

    LIMIT = 1 << 17

    def __init__(self) -> None:
        self.tags, self.paths, self.parents = Tags(), {}, {}

    def path(self, parent: int, signature: str) -> int:
        """A hash of the tags from the root to an element; a tag's role is its path, not its name alone."""
        key = parent, signature
        if key not in self.paths:
            self.paths[key] = made = xxhash.xxh64_intdigest(signature, parent)
            self.parents[made] = parent
        return self.paths[key]

    def ancestors(self, path: int) -> list[int]:
        """The paths of an element and of those around it, outermost first. To be asked before the next page."""
        out = []
        while path:
            out.append(path)
            path = self.parents[path]
        return out[::-1]

    def page(self, html: str) -> tuple[list[int], list[Text]]:
        """Hashes of all tokens in order of the page (tags of blocks and strings), and the strings."""
        if len(self.paths) > self.LIMIT:
            self.paths.clear()
            self.parents.clear()
        tokens, texts = [], []
        stack = [("", 0, 0, 0)]  # name, path, marks, level
        block, at = 0, 0
        last = html.rfind(">") + 1

        def string(start: int, end: int) -> None:
            piece = html[start:end]
            if not piece or piece.isspace():
                if piece and texts and texts[-1].block == block:
                    texts[-1] = texts[-1]._replace(text=texts[-1].text + " ")
                return
            _, path, marks, level = stack[-1]
            token = xxhash.xxh64_intdigest(" ".join(piece.split()), path)
            texts.append(Text(len(tokens), token, piece, block, marks, level, path))
            tokens.append(token)

        def close(names: frozenset | set, stops: frozenset | set) -> None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    del stack[i:]
                    return
                if stack[i][0] in stops:
                    return

        while tag := _TAG.search(html, at, last):
            string(at, tag.start())
            at = tag.end()
            slash, name, rest = tag.groups()
            if name is None:
                continue
            name = name.lower()
            if name == "br":
                if texts and texts[-1].block == block:
                    texts[-1] = texts[-1]._replace(text=texts[-1].text + "\n")
                continue
            is_block = name in BLOCK
            if is_block:
                block += 1
            if slash:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        if is_block:
                            tokens.append(stack[i][1] ^ END)
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK and not is_block:
                        break  # an inline element does not end the blocks inside which it is not
                continue
            if name in RAW:
                end = RAW[name].search(html, at)
                at = end.end() if end else len(html)
                continue
            if name in ENDS_P:
                close(P, NOT_P)
            if name in CLOSES:
                close(*CLOSES[name])
            signature, marks, level = self.tags[name, rest[:-1].strip().rstrip("/")]
            _, path, over, upper = stack[-1]
            if is_block:
                path = self.path(path, signature)
                tokens.append(path)
            if name in VOID or rest.endswith("/>") and name == "svg":
                continue
            if level and not over & NEVER_HERE:
                over &= ~SELDOM_HERE  # an article inside a block of a doubtful name is one
            if marks & HEADER:  # the article's own header holds its title
                marks += (0 if upper or level else SELDOM_HERE) - HEADER
            stack.append((name, path, (over | marks) & ~(HEADING if is_block and name not in HEADINGS else 0),
                          max(upper, level)))
        broken = _BROKEN.search(html, max(at, last))  # a tag that the page breaks off in is no text
        string(at, broken.start() if broken else len(html))
        return tokens, texts
