"""Main text of web pages by a linear-chain conditional random field over the leaf blocks.

A page is read as a stream of tags. A leaf block is the text between two block-level tags, with character
references decoded and white space collapsed. Each block has features of its own tag, its ancestors' tags,
roles, classes and ids, and its text; the chain adds the labels of neighbours. The field is trained on labelled
pages by its exact gradient (forward-backward) and a page's most likely labels are found by Viterbi.

Labelled pages are a few written out here, which cover layouts with and without semantic tags, and about
``LABELLED`` pages of the corpus, chosen by a hash, whose markup says what is the article. From each of those a
second copy hides that markup, so that the field also learns from the texts themselves.

Tags are read by the rules of HTML: a quote counts only after an equals sign, and one that is never closed ends with
its tag. A page is read in time proportional to its length, whatever it leaves open.

Defined results: a null or empty page, and one without a main block, give an empty text; markup that ends early
is read as far as it goes; a block of any length stays whole; formulas, drawings' labels and literal examples are
text; the words of a button or of a notice for readers without scripts are not, and a button is a space; repeated rows are judged one by one; other columns
play no part.
"""
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LABELLED = 300
ROUNDS = 120
RIDGE = 0.05

#: Fixed: elements that begin and end a block, elements without content, elements whose content is no text.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                       "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search "
                       "section select summary table tbody td tfoot th thead tr ul xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes noscript template".split())
#: Fixed: other elements that a block's features may name as ancestors; the rest count as one.
INLINE_TAGS = frozenset("a abbr audio b bdi bdo button canvas cite code data del dfn em font i ins kbd label map mark math meter object "
                        "output picture progress q ruby s samp small span strong sub sup svg time u var video".split())
#: Fixed: a start tag of one of the first ends open elements of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
ENDS_PARAGRAPH = BLOCK_TAGS - {"body", "head", "html", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "legend", "li", "dt", "dd"} | {"li", "dt", "dd"}
#: Words in class, id and role values that tell what an element is for.
HINTS = {
    "comment": "comment comments reply replies respond disqus discussion thread",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner adsense",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs",
    "side": "sidebar aside side rail widget related recommended popular trending",
    "foot": "footer foot copyright legal bottom colophon",
    "head": "header masthead head branding logo",
    "notice": "cookie cookies consent notice notification popup modal overlay gdpr alert toast newsletter subscribe",
    "form": "form search login signup signin contact",
    "share": "share sharing social tags meta byline author-box",
    "body": "article content main post entry story text body entry-content post-content article-body maincontent",
}
_HINT_OF = {word: name for name, words in HINTS.items() for word in words.split()}

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)"""
                    r"""((?>[\s/]++|[^\s/>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_KNOWN = BLOCK_TAGS | INLINE_TAGS
_LISTS = ("ul", "ol", "dl", "table", "select", "menu")


class Blocks:
    """The leaf blocks of a page: texts, each block's own tag, its ancestors' traits, and its share of link text."""

    __slots__ = ("texts", "tags", "traits", "links")

    def __init__(self):
        self.texts, self.tags, self.traits, self.links = [], [], [], []


def _traits(tag, attributes):
    """What an element adds to the traits of everything inside it."""
    found = {"in:" + (tag if tag in _KNOWN else "other")}
    if attributes and "=" in attributes:
        for name, *values in _NAMED.findall(attributes):
            for word in _WORD.findall("".join(values).lower()):
                hint = _HINT_OF.get(word)
                if hint:
                    found.add("hint:" + hint)
    return frozenset(found)


def read_blocks(html):
    """The leaf blocks of a page, in page order."""
    blocks = Blocks()
    # of each open element: its name, the traits inside it, the place of the innermost block element, the links around
    stack, places = [("", frozenset(), 0, 0)], {}
    parts, linked, at, end, unclosed = [], 0, 0, len(html), set()

    def close():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.texts.append(text)
                blocks.tags.append(stack[stack[-1][2]][0])
                blocks.traits.append(stack[-1][1])
                blocks.links.append(min(1.0, linked / len(text)))
            parts.clear()
        linked = 0

    def innermost(names):
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    def pop(place):
        """End the element at a place and all inside it; the page itself, at 0, stays."""
        while place and len(stack) > place:
            places[stack.pop()[0]].pop()

    def content(tag):
        """The text up to the end tag of a raw element, or None if it is never closed."""
        nonlocal at
        finish = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
        if finish is None:
            unclosed.add(tag)
            return None
        begin, at = at, finish.end()
        return html[begin:finish.start()]

    def add(text):
        nonlocal linked
        parts.append(text)
        linked += len(text) if stack[-1][3] else 0

    while at < end:
        mark = html.find("<", at)
        if mark < 0:
            mark = end
        if mark > at:
            text = html[at:mark]
            add(unescape(text) if "&" in text else text)
        if mark == end:
            break
        token = _TOKEN.match(html, mark)
        if token is None:  # a lone < is text
            parts.append("<")
            at = mark + 1
            continue
        at = token.end()
        slash, tag, attributes = token.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK_TAGS:
            close()
        if slash:
            place = innermost((tag,))
            pop(place if tag in BLOCK_TAGS or place > stack[-1][2] else 0)
            continue
        if tag in RAW_TAGS:
            if not attributes.endswith("/") and content(tag) is None:
                at = end
            continue
        if tag == "button" and content(tag) is not None:
            parts.append(" ")
            continue
        if tag in ENDS_PARAGRAPH:
            place = innermost(("p",))
            pop(place if place == stack[-1][2] else 0)
        if tag in CLOSES:
            place = innermost(CLOSES[tag])
            pop(place if place > innermost(_LISTS) else 0)
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        _, traits, block, links = stack[-1]
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, traits | _traits(tag, attributes), len(stack) if tag in BLOCK_TAGS else block, links + (tag == "a")))
        if tag == "xmp":
            text = content(tag)
            add(html[at:] if text is None else text)
            at = end if text is None else at
            close()
            pop(len(stack) - 1)
    close()
    return blocks


def _bin(x, edges):
    return sum(x >= e for e in edges)


def features(blocks, hidden=False):
    """A list of feature names for each block; ``hidden`` leaves out what the markup says."""
    n, out = len(blocks.texts), []
    for i, text in enumerate(blocks.texts):
        words = text.count(" ") + 1
        names = ["bias", f"words:{_bin(words, (2, 4, 8, 15, 30, 60))}", f"link:{_bin(blocks.links[i], (0.1, 0.5, 0.9))}",
                 f"stop:{text[-1] in '.!?…:;\"”»'}", f"commas:{_bin(text.count(','), (1, 3))}"]
        if "©" in text or "·" in text or "|" in text:
            names.append("sign")
        if not hidden:
            tag = blocks.tags[i]
            names += [f"tag:{tag}", *blocks.traits[i], *(f"{t}&tag:{tag}" for t in blocks.traits[i] if t.startswith("hint:"))]
        out.append(names)
    if out:
        out[0].append("first")
        out[-1].append("last")
    return out


def _names():
    """Every feature name that :func:`features` can give."""
    tags, hints = sorted(BLOCK_TAGS | {""}), sorted(HINTS)
    return ["bias", "sign", "first", "last", "stop:False", "stop:True", *(f"words:{i}" for i in range(7)), *(f"link:{i}" for i in range(4)),
            *(f"commas:{i}" for i in range(3)), *(f"tag:{t}" for t in tags), *(f"in:{t}" for t in sorted(_KNOWN | {"other"})),
            *(f"hint:{h}" for h in hints), *(f"hint:{h}&tag:{t}" for h in hints for t in tags)]


_PLACE = {name: i for i, name in enumerate(_names())}


def coded(lists):
    """Flat feature codes and where each block's begin (one more entry)."""
    flat = [_PLACE[name] for names in lists for name in names]
    return np.array(flat, np.int64), np.concatenate([[0], np.cumsum([len(names) for names in lists])]).astype(np.int64)


class Field:
    """Weights of features by label (0 other, 1 main), of neighbouring labels, and of the first label."""

    def __init__(self):
        self.state, self.pair, self.start = np.zeros((len(_PLACE), 2)), np.zeros((2, 2)), np.zeros(2)

    def scores(self, codes, first):
        if len(first) < 2:
            return np.zeros((0, 2))
        return np.add.reduceat(self.state[codes], first[:-1], axis=0)

    def viterbi(self, scores, pages):
        """The best labels of many pages; ``pages`` holds the first block of each page (one more entry)."""
        size = np.diff(pages)
        order = np.argsort(-size, kind="stable")
        begin, size = pages[:-1][order], size[order]
        best = scores.copy()
        back = np.zeros(scores.shape, np.int8)
        for j in range(int(size.max(initial=0))):
            at = begin[:np.searchsorted(-size, -j, "left")] + j
            if j == 0:
                best[at] += self.start
            else:
                ways = best[at - 1][:, :, None] + self.pair[None]
                back[at] = ways.argmax(axis=1)
                best[at] += ways.max(axis=1)
        labels = np.zeros(len(scores), np.int8)
        for j in range(int(size.max(initial=0)) - 1, -1, -1):
            n = np.searchsorted(-size, -j, "left")
            at = begin[:n] + j
            ends = size[:n] == j + 1
            labels[at[ends]] = best[at[ends]].argmax(axis=1)
            on = at[~ends]
            labels[on] = back[on + 1, labels[on + 1]]
        return labels


def train(examples, rounds=ROUNDS, ridge=RIDGE):
    """Fit a field to (codes, first, labels) pages by gradient ascent on the conditional likelihood."""
    field = Field()
    examples = [e for e in examples if len(e[2])]
    if not examples:
        return field
    codes = np.concatenate([e[0] for e in examples])
    lengths = np.concatenate([np.diff(e[1]) for e in examples])
    first = np.concatenate([[0], np.cumsum(lengths)])
    labels = np.concatenate([e[2] for e in examples])
    pages = np.concatenate([[0], np.cumsum([len(e[2]) for e in examples])])
    block_of = np.repeat(np.arange(len(labels)), lengths)
    size = np.diff(pages)
    order = np.argsort(-size, kind="stable")
    begin, size = pages[:-1][order], size[order]
    alive = [np.searchsorted(-size, -j, "left") for j in range(int(size.max()))]
    gold = np.eye(2)[labels]
    moment, square = None, None
    for turn in range(1, rounds + 1):
        scores = field.scores(codes, first)
        fore, back = scores.copy(), np.zeros_like(scores)
        for j, n in enumerate(alive):
            at = begin[:n] + j
            fore[at] += field.start if j == 0 else np.logaddexp.reduce(fore[at - 1][:, :, None] + field.pair, axis=1)
        pair = np.zeros((2, 2))
        for j in range(len(alive) - 1, 0, -1):
            at = begin[:alive[j]] + j
            inner = scores[at] + back[at]
            back[at - 1] = np.logaddexp.reduce(field.pair + inner[:, None, :], axis=2)
            joint = fore[at - 1][:, :, None] + field.pair + inner[:, None, :]
            joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(at), 4), axis=1)[:, None, None])
            pair += (gold[at - 1][:, :, None] * gold[at][:, None, :] - joint).sum(axis=0)
        both = fore + back
        error = gold - np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])
        state = np.zeros_like(field.state)
        for y in range(2):
            state[:, y] = np.bincount(codes, weights=error[block_of, y], minlength=len(_PLACE))
        slope = np.concatenate([(state - ridge * field.state).ravel(), (pair - ridge * field.pair).ravel(),
                                error[pages[:-1]].sum(axis=0) - ridge * field.start])
        moment = 0.1 * slope if moment is None else 0.9 * moment + 0.1 * slope
        square = 0.001 * slope ** 2 if square is None else 0.999 * square + 0.001 * slope ** 2
        move = 0.1 * (moment / (1 - 0.9 ** turn)) / (np.sqrt(square / (1 - 0.999 ** turn)) + 1e-8)
        field.state += move[:-6].reshape(field.state.shape)
        field.pair += move[-6:-2].reshape(2, 2)
        field.start += move[-2:]
    return field


_LONG = ("The council met on Tuesday to discuss the new bridge, and after a long debate the members agreed to wait for the "
         "engineers, who expect to finish their report before the end of the month.")
_MORE = "Nobody was surprised by the result, although a few had hoped for more. The work will go on in spring."
#: Written pages; a block that begins with + is main text, one that begins with - is not.
WRITTEN = [
    f"<body><header><h1>-Daily News</h1><nav><ul><li><a>-Home</a><li><a>-Sport</a></ul></nav></header><main><article><h1>+A bridge</h1>"
    f"<p>+{_LONG}<p>+{_MORE}<div class=ad>-Buy now</div><h2>+What next</h2><p>+{_MORE}<ul><li>+First point<li>+Second point</ul>"
    f"<section id=comments><h3>-Comments</h3><p>-{_MORE}<p>-Great read!</section></article></main>"
    f"<aside><h3>-Most read</h3><ul><li><a>-Rain again</a></ul></aside><footer><p>-© 2020 Daily News</footer>",
    f"<body><div id=top-menu><a>-Start</a> <a>-Shop</a></div><div class='cookie-notice'><p>-{_MORE}<button>-Accept</button></div>"
    f"<div id=content><h1>+A bridge</h1><p>+{_LONG}</p><p>+{_MORE}</p><blockquote>+Wait and see.</blockquote><p>+{_LONG}</p></div>"
    f"<div class=sidebar><p>-{_LONG}</p><form><label>-Search</label></form></div><div class=footer><p>-All rights reserved.</p></div>",
    f"<body><table><tr><td>-<a>-Home</a><td>-<a>-News</a></table><div><h2>+A bridge</h2><p>+{_LONG}<p>+{_MORE}<p>+{_LONG}</div>"
    f"<div class=comment><p>-{_LONG}</p></div><div class=comment><p>-I agree, thanks.</p></div><div>-© 2019 · Imprint</div>",
    f"<body><div role=banner><p>-The Paper</p></div><div role=navigation><a>-World</a></div><div role=main><h1>+A bridge</h1>"
    f"<p>+{_MORE}<figure><figcaption>+The old bridge.</figcaption></figure><p>+{_LONG}<div class='share social'><a>-Share this</a></div>"
    f"<p>+{_MORE}</div><div role=complementary><h4>-Related</h4><a>-Another story</a></div><div role=contentinfo>-Contact</div>",
    f"<body><div class=banner>-Sale today, everything must go.</div><article><header><h1>+A bridge</h1></header><p>+{_LONG}<p>+{_MORE}"
    f"<form class=newsletter><p>-Subscribe to our letter, and never miss a story again.</form><p>+{_LONG}"
    f"<aside><p>-{_MORE}</aside><table><tr><td>+Length<td>+300 m</table><footer><p>-Filed under bridges</footer></article>"
    f"<div id=disqus_thread><ul><li><p>-{_LONG}<li><p>-{_MORE}</ul></div><nav><a>-Older</a><a>-Newer</a></nav>",
    f"<body><nav>-Home</nav><article><p>+Short one.</p></article><footer>-© · Imprint</footer>",
    f"<body><nav><ul><li><a>-One</a></li><li><a>-Two</a></li></ul></nav><div class=ad>-{_MORE}</div><article><h1>+Title</h1>"
    f"<p>+{_MORE}</p></article><footer>-© site · {_LONG}</footer>",
    f"<body><div class='post-content'><p>+{_LONG}</p><pre>+x = 1</pre><p>+{_MORE}</p></div><div class='popup modal'><p>-{_LONG}</p></div>"
    f"<div class='widget'><p>-{_MORE}</p></div><div class='pagination'><a>-1</a><a>-2</a></div>",
]
_NOT_MAIN = frozenset("in:nav in:aside in:footer in:form in:dialog in:menu in:button hint:comment hint:advert hint:menu hint:side "
                      "hint:foot hint:notice hint:form hint:share".split())


def written_examples():
    for page in WRITTEN:
        blocks = read_blocks(page)
        labels = np.array([t.startswith("+") for t in blocks.texts], np.int8)
        blocks.texts = [t.lstrip("+-") or "x" for t in blocks.texts]
        for _ in range(4):  # as much weight as a few corpus pages of each layout
            yield (*coded(features(blocks)), labels)
        yield (*coded(features(blocks, True)), labels)


def marked_examples(html):
    """A corpus page whose markup names the article: labels from it, with and without markup features."""
    blocks = read_blocks(html)
    labels = np.array([bool(t & {"in:article", "in:main"}) and not t & _NOT_MAIN for t in blocks.traits], np.int8)
    if labels.any():
        yield (*coded(features(blocks)), labels)
        yield (*coded(features(blocks, True)), labels)


def learn(pages: DataFrame, html="html", labelled=LABELLED) -> Field:
    """Train on the written pages and a bounded sample of the corpus, chosen by a hash of the page."""
    total = pages.count()
    draw = F.pmod(F.xxhash64(F.lit("html"), F.col(html)), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = (pages.filter(F.col(html).isNotNull() & (draw * max(1, total) < 2 * labelled))
            .select(F.col(html).alias("h")).dropDuplicates().orderBy(F.xxhash64("h")).limit(labelled).toLocalIterator())
    examples = list(written_examples())
    for row in rows:
        examples += marked_examples(row.h)
    return train(examples)


def extract(pages: DataFrame, field: Field, carry=("page_id", "url"), html="html") -> DataFrame:
    """Columns ``carry`` and the main text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(field)
    names = [c for c in carry if c not in (html, "text")]
    rows = pages.select(*[F.col(c) for c in names], F.col(html).alias("html"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                read = [read_blocks(h or "") for h in batch.column("html").to_pylist()]
                codes, first = coded([names for b in read for names in features(b)])
                pages = np.concatenate([[0], np.cumsum([len(b.texts) for b in read])])
                main = shared.value.viterbi(shared.value.scores(codes, first), pages).tolist()
                texts = ["\n".join(t for t, y in zip(b.texts, main[p:]) if y) for b, p in zip(read, pages.tolist())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], [*names, "text"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{fields}text string")


def op8_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = extract(pages, learn(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
