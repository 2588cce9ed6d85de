"""Plain Python answers for small tables; each takes lists of rows as dicts."""

import hashlib
import re
from collections import defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontamination(docs, items, size=10):
    windows = defaultdict(set)
    for item in items:
        words = ALNUM.findall((item["text"] or "").translate(FOLD))
        if item["item_id"] is None or not words:
            continue
        for i in range(max(1, len(words) - size + 1)):
            windows[tuple(words[i : i + size])].add(item["item_id"])
    lengths = sorted({len(w) for w in windows})
    out = []
    for doc in docs:
        words = ALNUM.findall((doc["text"] or "").translate(FOLD))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                of = windows.get(tuple(words[i : i + n]))
                if of:
                    hit.update(range(i, i + n))
                    found |= of
        out.append((doc["doc_id"], len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def licenses(docs, phrases):
    out = []
    for doc in docs:
        words = ALNUM.findall((doc["text"] or "").translate(FOLD))
        places = []
        for phrase, label in phrases.items():
            want = phrase.split()
            places += [(i, label) for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]
        starts = [i for i, _ in places]
        out.append((doc["doc_id"], len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    return out


def substrings(docs, size=20):
    """Rows of one id count as one document; no id comes last."""
    last = 2**63 - 1
    rows = [((last if d["doc_id"] is None else d["doc_id"]), d["doc_id"], NOT_SPACE.findall(d["text"] or "")) for d in docs]
    first = {}
    for key, _, words in rows:
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            first[window] = min(first.get(window, (last + 1, 0)), (key, i))
    out = []
    for key, doc_id, words in rows:
        gone = set()
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] < (key, i):
                gone.update(range(i, i + size))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(gone), sha(" ".join(kept))))
    return out


def shingles(text, size):
    words = NOT_SPACE.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard(docs, size=4, percent=85):
    """(doc_id, set size, smallest id of the component) by all pairs that share an n-gram."""
    sets = [shingles(d["text"], size) for d in docs]
    classes = defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            classes[s].append(i)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for members in classes.values():
        for i in members:
            parent[root(i)] = root(members[0])
    holds = defaultdict(list)
    for s, members in classes.items():
        for g in s:
            holds[g].append(members[0])
    for s, members in classes.items():
        a, both = members[0], defaultdict(int)
        for g in s:
            for b in holds[g]:
                if b < a:
                    both[b] += 1
        for b, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[b]) - n):
                parent[root(a)] = root(b)
    least = {}
    for i, d in enumerate(docs):
        if sets[i] and d["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), d["doc_id"]), d["doc_id"])
    return [(d["doc_id"], len(sets[i]), least.get(root(i)) if sets[i] else d["doc_id"]) for i, d in enumerate(docs)]


def url_verdicts(pages, rules, default="allow"):
    out = []
    for page in pages:
        rest = page["url"].split("://", 1)[1] if page["url"] and "://" in page["url"] else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(FOLD)
        fits = [(-len(h + p), v != "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = min(fits, default=(0, 0, None, default))
        out.append((page["page_id"], host, path, best[2], best[3]))
    return out


def archives(pages, least=1000):
    payloads = [(p["page_id"], (p["html"] or "").encode()) for p in pages]
    top = {}
    for page, raw in payloads:
        if len(raw) >= least:
            top[raw] = max((x for x in (top.get(raw), page) if x is not None), default=None)
    out = []
    for page, raw in payloads:
        again = len(raw) >= least and top[raw] is not None and top[raw] != page
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[raw] if again else None))
    return out
