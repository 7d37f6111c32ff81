"""Main text of web pages by union-free wrappers of their hosts (operator 8).

A wrapper is a union-free regular expression over tags and text slots, in which
groups may be optional or repeated. It is inferred for each host by aligning
the token streams of its pages one after the other: equal neighbours fold into
a repeated group, a group known to repeat in one page folds in others too, and
tokens that only some pages have become optional. Texts are tokens too: a text
that matches over most of a host's articles is a literal of the template, one
that differs is a slot. Pages with the same stream are one row with a count, and
a host with very many streams is folded in chunks whose wrappers are aligned in
turn, so no task holds a host's pages.

Whether a text matches is counted over all pages of the host that are mostly
their own: on a copy of an article that the host has under many addresses most of
the text is frequent, so copies bear no witness and keep their text. Headings,
and labels of a few words inside a marked article, are always slots.

Every slot carries votes: how many pages had it within the article (or, where a
page marks no article, outside menus, headers, footers, sidebars, notices,
adverts, forms and comments). A page is read by aligning it with its host's
wrapper; the text in slots with a majority of votes is its main text.

Defined cases: a null or empty html, or one without main text, gives an empty
text; a null url belongs to the host ''; repeated rows are read one by one;
very long pages are read whole (alignment takes memory linear in their tokens);
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtally.llm.common import Work, map_rows

#: Streams folded into one wrapper at a time.
CHUNK = 256
#: Longest run of tokens that may fold into a repeated group.
LONGEST_GROUP = 24
#: A literal of the template stands on at least so many pages, and on more than half of the host's.
LEAST_PAGES = 4
#: Shorter texts inside a marked article are labels of it.
LEAST_WORDS = 5
#: Cells of an alignment table; larger alignments are halved first.
TABLE_CELLS = 1 << 18

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = re.compile(r"</(script|style|textarea|title|noscript|template|iframe|svg)\s*>", re.I)
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
EXCLUDED = frozenset("nav header footer aside form script style noscript template button select option input textarea label iframe svg head title dialog menu figcaption".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_EXCLUDED_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|header|footer|sidebar\w*|side|cookie\w*|consent|notice\w*|alert\w*|"
    r"comment\w*|disqus|respond|replies|social|share|sharing|related|recommend\w*|newsletter|subscribe|popup|modal|pagination|pager|tags|widget\w*|toolbar|login|search)(?:$|[\s_-])",
    re.I,
)

_TALK_NAME = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus|respond|replies|reply)(?:$|[\s_-])", re.I)
#: Names that say what a layout has beside the text, not what the element is.
_HINT = re.compile(r"(?<!\S)(?:has|no|with|without|hide|show)[-_]\S+", re.I)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, '' for none."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def is_inline(kind: str) -> bool:
    return kind.strip("</>").split(" ")[0] in INLINE


def tokens(page: str | None) -> list[tuple[str, str, bool, int]]:
    """(kind, text, wanted, place) of a whole page; wanted: the text's own surroundings let it be main text.

    The kind of an opening tag includes its class, id and role without digits;
    that of a text is ``#`` and the section it stands in. The place is 2 in a
    heading, 1 elsewhere in a marked article, else 0.
    """
    page = page or ""
    out: list[tuple[str, str, bool, int]] = []
    stack: list[tuple[str, str, bool, str]] = []  # open elements: name, why excluded, within an article, section
    at = 0

    def text(s: str) -> None:
        if s.strip():
            bad, inside, section = stack[-1][1:] if stack else ("", False, "")
            place = 2 if any(e[0] in HEADINGS for e in stack[-4:]) else int(inside)
            out.append((f"#{section}", s, not bad and (inside or None), place))
        elif s:  # a space between inline tags belongs to the text before them
            for k in range(len(out) - 1, -1, -1):
                if out[k][0][0] == "#":
                    out[k] = (out[k][0], out[k][1] + s, *out[k][2:])
                elif is_inline(out[k][0]):
                    continue
                break

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        name = m[1].lower()
        if m[0][1] == "/":
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            out.append((f"</{name}>", "", False, 0))
            continue
        names = " ".join(a[1] or a[2] or a[3] for a in _ATTR.findall(m[2]))
        kind = re.sub(r"\d+", "", names).strip()
        out.append((f"<{name} {kind}>" if kind else f"<{name}>", "", False, 0))
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            out.append((f"</{name}>", "", False, 0))
        elif name not in VOID and not m[0].endswith("/>"):
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            up = stack[-1] if stack else ("", "", False, "")
            main = name in MAIN
            names = _HINT.sub(" ", names)
            bad = up[1] or _excluded(name, names, up[2])
            if name == "main" or name == "article" and not up[2] and up[1] in ("", "name", "form"):
                # the article itself: a layout's name or a form around it does not exclude it
                bad = "talk" if name == "article" and _TALK_NAME.search(names) else ""
            section = out[-1][0].strip("<>").replace(" ", ".") if main or bad and not up[1] else up[3]
            stack.append((name, bad, up[2] or main, section))
    # Texts outside an article (None so far) are wanted only on pages without one.
    loose = not any(t[2] for t in out)
    return [(k, s, loose if ok is None else ok, place) for k, s, ok, place in out]


def _excluded(name: str, names: str, inside: bool) -> str:
    """Why an element is no main text: its tag, ``talk`` for reader comments, ``name`` for another class or id, '' for not at all."""
    if name in EXCLUDED and not (name == "header" and inside):  # an article's own header is part of it
        return name
    if name in ("html", "body"):
        return ""
    return "talk" if _TALK_NAME.search(names) else "name" if _EXCLUDED_NAME.search(names) else ""


def block_runs(toks: list[tuple]) -> list[list[int]]:
    """Positions of the texts of each block: texts with only inline tags between them."""
    runs, run = [], []
    for i, t in enumerate(toks):
        if t[0][0] == "#":
            run.append(i)
        elif run and not is_inline(t[0]):
            runs.append(run)
            run = []
    return runs + [run] if run else runs


def text_hashes(toks: list[tuple]) -> tuple[dict[int, int], dict[int, int], int]:
    """Of a page's wanted texts: position -> hash of its block, hash -> characters of the blocks that may be literals, characters in all."""
    at, able, total = {}, {}, 0
    for run in block_runs(toks):
        run = [i for i in run if toks[i][2]]
        words = entities.unescape("".join(toks[i][1] for i in run)).split()
        if words:
            size = sum(map(len, words))
            total += size
            place = toks[run[0]][3]
            if place == 0 or place == 1 and len(words) >= LEAST_WORDS:
                h = int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                at.update(dict.fromkeys(run, h))
                able[h] = able.get(h, 0) + size
    return at, able, total


# A unit is [key, slots, optional]: key is a tag, "#section", "=hash" (a literal text) or "(k1 k2 ...)+"; slots list, for each text of the unit, what was found there.


def fold(units: list[list], known: dict[str, list[str]]) -> list[list]:
    """Units with equal neighbouring runs, and runs known to repeat, folded into repeated groups."""
    changed = True
    while changed:
        changed = False
        keys = [u[0] for u in units]
        bodies = sorted(known.items(), key=lambda kv: len(kv[1]))
        out, i = [], 0
        while i < len(units):
            done = False
            for key, body in bodies:
                n = len(body)
                if keys[i : i + n] == body:
                    out.append([key, [s for u in units[i : i + n] for s in u[1]], any(u[2] for u in units[i : i + n])])
                    i, done, changed = i + n, True, True
                    break
            if not done and out and out[-1][0] == keys[i] and keys[i][0] == "(":
                out[-1] = [keys[i], [a + b for a, b in zip(out[-1][1], units[i][1])], out[-1][2] and units[i][2]]
                i, done, changed = i + 1, True, True
            if not done:
                out.append(units[i])
                i += 1
        units = out
        keys = [u[0] for u in units]
        for n in range(1, LONGEST_GROUP + 1):
            i = next((i for i in range(len(units) - 2 * n + 1) if keys[i][0] == "<" and keys[i][1] != "/" and keys[i : i + n] == keys[i + n : i + 2 * n]), None)
            if i is not None:
                known["(" + " ".join(keys[i : i + n]) + ")+"] = keys[i : i + n]
                changed = True
                break
    return units


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of keys, as pairs of positions; memory linear in the keys."""
    out: list[tuple[int, int]] = []
    todo = [(list(range(len(a))), list(range(len(b))))]  # parts still to align, the last first
    while todo:
        x, y = todo.pop()
        start = 0
        while start < min(len(x), len(y)) and a[x[start]] == b[y[start]]:
            start += 1
        out += zip(x[:start], y[:start])
        x, y = x[start:], y[start:]
        end = 0
        while end < min(len(x), len(y)) and a[x[-1 - end]] == b[y[-1 - end]]:
            end += 1
        if end:
            todo.append((x[-end:], y[-end:]))
            x, y = x[:-end], y[:-end]
        # keys that the other side lacks match nothing
        both = {a[i] for i in x} & {b[j] for j in y}
        if not both:
            continue
        x, y = [i for i in x if a[i] in both], [j for j in y if b[j] in both]
        if len(x) * len(y) <= TABLE_CELLS or len(x) == 1:
            out += [(x[i], y[j]) for i, j in _table([a[i] for i in x], [b[j] for j in y])]
            continue
        half, keys = len(x) // 2, [b[j] for j in y]
        left = _prefix_lengths([a[i] for i in x[:half]], keys)
        right = _prefix_lengths([a[i] for i in reversed(x[half:])], keys[::-1])[::-1]
        cut = int(np.argmax(left + right))
        todo += [(x[half:], y[cut:]), (x[:half], y[:cut])]
    return sorted(out)


def _prefix_lengths(x: list[str], y: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of x with each prefix of y; a bit for each place of y."""
    places: dict[str, int] = {}
    for j, k in enumerate(y):
        places[k] = places.get(k, 0) | 1 << j
    every = (1 << len(y)) - 1
    v = every
    for k in x:
        u = v & places.get(k, 0)
        v = (v + u | v - u) & every
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _table(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
    pairs, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


class Wrapper:
    """Units [key, votes, optional] with the bodies of their repeated groups; votes: [pages for, pages] of each slot."""

    def __init__(self, units: list[list] | None = None, known: dict[str, list[str]] | None = None):
        self.units, self.known = units, known or {}

    def dumps(self) -> str:
        return json.dumps([self.units, self.known])

    @classmethod
    def loads(cls, s: str) -> Wrapper:
        return cls(*json.loads(s))

    def _take(self, units: list[list]) -> None:
        """Align with more units [key, votes, optional]; what only one side has becomes optional."""
        units = _refold(units, self.known)
        if self.units is None:
            self.units = units
            return
        self.units = _refold(self.units, self.known)
        out, i, j = [], 0, 0
        for p, q in [*align([u[0] for u in self.units], [u[0] for u in units]), (len(self.units), len(units))]:
            out += [[k, v, True] for k, v, _ in self.units[i:p]] + [[k, v, True] for k, v, _ in units[j:q]]
            if p < len(self.units):
                u, w = self.units[p], units[q]
                out.append([u[0], [[a[0] + b[0], a[1] + b[1]] for a, b in zip(u[1], w[1])], u[2] or w[2]])
            i, j = p + 1, q + 1
        self.units = out

    def add_stream(self, stream: list[tuple[str, bool]], pages: int) -> None:
        self._take([[k, [[pages if ok else 0, pages]] if k[0] == "#" else [], False] for k, ok in stream])

    def add_wrapper(self, other: Wrapper) -> None:
        self.known.update(other.known)
        if other.units is not None:
            self._take(other.units)

    def read(self, stream: list[tuple[str, bool]]) -> list[bool]:
        """Whether each text of a page's stream lies in a slot with a majority of votes; a text without a slot has its own vote, a literal none."""
        number, units, out = 0, [], [ok and k[0] == "#" for k, ok in stream if k[0] in "#="]
        for k, _ in stream:
            units.append([k, [[number]] if k[0] == "#" else [], False])
            number += k[0] in "#="
        units = fold(units, dict(self.known))
        mine = self.units or []
        for p, q in align([u[0] for u in mine], [u[0] for u in units]):
            for votes, texts in zip(mine[p][1], units[q][1]):
                for t in texts:
                    out[t] = 2 * votes[0] > votes[1]
        return out


def _refold(units: list[list], known: dict[str, list[str]]) -> list[list]:
    """Wrapper units folded by all groups found to repeat so far; votes for one slot add up."""
    folded = fold([[k, [[v] for v in votes], o] for k, votes, o in units], known)
    return [[k, [[sum(v[0] for v in s), sum(v[1] for v in s)] for s in slots], o] for k, slots, o in folded]


def read_pages(pages: DataFrame) -> DataFrame:
    """Of each page: host, tokens (texts with the hash of their block), hashes and characters of blocks that may be literals, characters in all."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"host": cols["host"], "tokens": [], "able": [], "sizes": [], "total": []}
        for h in cols["html"]:
            toks = tokens(h)
            at, able, total = text_hashes(toks)
            out["tokens"].append(json.dumps([[t[0], t[2], at.get(i, 0)] if t[0][0] == "#" else t[0] for i, t in enumerate(toks)]))
            out["able"].append(list(able))
            out["sizes"].append(list(able.values()))
            out["total"].append(total)
        return out

    schema = "host string, tokens string, able array<long>, sizes array<long>, total long"
    return map_rows(pages.select(host_of(F.col("url")).alias("host"), "html"), run, schema, rows=128)


def _on_most(pages: DataFrame, texts: str, name: str) -> DataFrame:
    """(host, ``name``): the texts held by at least LEAST_PAGES and more than half of a host's pages.

    A host keeps fewer than twice as many as its pages have on average, since
    each takes more than half of them; so its list is bounded by a page.
    """
    per = pages.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("pages"))
    held = pages.select("host", F.explode(texts).alias("t")).groupBy("host", "t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    return held.join(per, held.host == per.h).where("2 * n > pages").groupBy("host").agg(F.sort_array(F.collect_set("t")).alias(name))


def literals(found: DataFrame, work: Work) -> DataFrame:
    """(host, literals): hashes of the texts that are frequent on a host, among its pages whose text is mostly not."""
    blocks = found.where("total > 0").select("host", "able", "sizes", "total")
    often = work.store(_on_most(blocks, "able", "often").withColumnRenamed("host", "o_host"), "often")
    j = blocks.join(often, blocks.host == often.o_host)
    shared = F.expr("aggregate(arrays_zip(able, sizes), 0L, (a, x) -> a + if(array_contains(often, x.able), x.sizes, 0L))")
    own = work.store(j.where(2 * shared < F.col("total")).select("host", F.array_intersect("able", "often").alias("held")), "own")
    return _on_most(own, "held", "literals")


def as_stream(toks: list, known: frozenset[int]) -> list[tuple[str, bool]]:
    """(key, own vote) of a page's tokens: a text is a slot, or ``=hash`` if it is a literal of the host."""
    return [(t, False) if isinstance(t, str) else (f"={t[2]}", False) if t[2] in known else (t[0], t[1]) for t in toks]


def streams(found: DataFrame, known: DataFrame) -> DataFrame:
    """(host, stream) -> pages: the distinct token streams of each host, map-side combined."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out = [json.dumps(as_stream(json.loads(t), frozenset(k or ()))) for t, k in zip(cols["tokens"], cols["literals"])]
        return {"host": cols["host"], "stream": out}

    known = known.withColumnRenamed("host", "k_host")
    j = found.join(known, found.host == known.k_host, "left").select("host", "tokens", "literals")
    return map_rows(j, run, "host string, stream string", rows=128).groupBy("host", "stream").agg(F.count(F.lit(1)).alias("pages"))


def _infer(pdf: pd.DataFrame) -> pd.DataFrame:
    w = Wrapper()
    for s, n in sorted(zip(pdf["stream"], pdf["pages"]), key=lambda x: (len(x[0]), x[0])):
        w.add_stream([tuple(x) for x in json.loads(s)], int(n))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [w.dumps()]})


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    w = Wrapper()
    for s in sorted(pdf["wrapper"], key=lambda x: (-len(x), x)):
        w.add_wrapper(Wrapper.loads(s))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [w.dumps()]})


def wrappers(pages: DataFrame, work: Work) -> DataFrame:
    """(host, wrapper, literals) of every host, folded in chunks of about CHUNK streams."""
    read = work.store(read_pages(pages), "tokens")
    known = work.store(literals(read, work), "literals")
    found = work.store(streams(read, known), "streams")

    def chunked(df: DataFrame, of: str) -> DataFrame:
        per = df.groupBy(F.col("host").alias("h")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
        j = df.join(per, df.host == per.h).drop("h")
        return j.withColumn("chunk", F.pmod(F.xxhash64(of), F.col("chunks"))).drop("chunks")

    out = work.store(chunked(found, "stream").groupBy("host", "chunk").applyInPandas(lambda pdf: _infer(pdf), "host string, wrapper string"), "wrappers_0")
    step = 0
    while (out.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        step += 1
        out = work.store(chunked(out, "wrapper").groupBy("host", "chunk").applyInPandas(lambda pdf: _merge(pdf), "host string, wrapper string"), f"wrappers_{step}")
    known = known.withColumnRenamed("host", "k_host")
    # stored, so that its size is known when pages are joined with it
    return work.store(out.join(known, out.host == known.k_host, "left").select("host", "wrapper", "literals"), "hosts")


@lru_cache(maxsize=64)
def _loaded(s: str) -> tuple[Wrapper, dict[tuple, list[bool]]]:
    return Wrapper.loads(s), {}


def main_text(page: str | None, wrapper: str, known: frozenset[int] = frozenset()) -> str:
    """Blocks of the page's main text, one a line; ``known`` are the literals of its host."""
    toks = tokens(page)
    w, read = _loaded(wrapper)
    at = text_hashes(toks)[0] if known else {}
    stream = tuple(as_stream([[t[0], t[2], at.get(i, 0)] if t[0][0] == "#" else t[0] for i, t in enumerate(toks)], known))
    if stream not in read:
        if len(read) >= 2000:
            read.clear()
        read[stream] = w.read(list(stream))
    wanted = iter(read[stream])
    blocks, run = [], []
    for kind, text, _, _ in toks:
        if kind[0] == "#":
            if next(wanted):
                run.append(text)
        elif is_inline(kind):
            if kind.startswith("<br") and run:
                run.append(" ")
        elif run:
            blocks.append("".join(run))
            run = []
    blocks.append("".join(run))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract(pages: DataFrame, work: Work) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    hosts = wrappers(pages, work).withColumnRenamed("host", "w_host")
    j = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    j = j.join(hosts, j.host == hosts.w_host, "left").select("page_id", "url", "html", "wrapper", "literals")

    def run(cols: dict[str, list]) -> dict[str, list]:
        text = [main_text(h, w or "[null, {}]", frozenset(k or ())) for h, w, k in zip(cols["html"], cols["wrapper"], cols["literals"])]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}

    return map_rows(j, run, "page_id long, url string, text string, n_chars long", rows=128)
