"""Plain single-machine versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed_bytes(texts, width):
    seen = defaultdict(int)
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for p in range(len(r) - width + 1):
            seen[r[p : p + width]] += 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - width + 1):
            if seen[r[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def kept_bytes(texts, width):
    raws = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for r in raws:
        for p in range(len(r) - width + 1):
            seen[hash(r[p : p + width])] += 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - width + 1):
            if seen[hash(r[p : p + width])] > 1:
                gone[p : p + width] = b"\1" * width
        out.append(bytes(b for b, g in zip(r, gone) if not g))
    return out


def removed_words(rows, width):
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def url_verdicts(pages, rules):
    """{id: verdict} of (id, url) by the template tree, one node at a time."""
    found = []
    for i, url in pages:
        _, sep, rest = (url or "").partition("://")
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", rest if sep else "", re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(r), v) for v, r in rules if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
        parts = [re.sub("[0-9]+", "*", re.sub("[0-9a-fA-F-]{12,}", "*", s)) for s in path.removeprefix("/").split("/")]
        look = lambda segments: re.sub(r"[^\W\d_]+", "a", "/".join(segments))
        shape = tuple(parts)
        found.append((i, host, shape, max(fits)[1] if fits else None))
    template = {(h, s): "" for _, h, s, _ in found}
    for k in range(max((len(s) for _, _, s, _ in found), default=0)):
        nodes = defaultdict(list)
        for _, h, s, v in found:
            if len(s) > k:
                nodes[h, template[h, s]].append((s, v))
        renamed = {}
        for (h, t), rows in nodes.items():
            count, lab, bad, rests = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
            cell = defaultdict(int)
            for s, v in rows:
                rest = (len(s) > k + 1, look(s[k + 1 :]))
                count[s[k]] += 1
                rests[rest] += 1
                cell[s[k], rest] += 1
                lab[s[k]] += v is not None
                bad[s[k]] += v == "block"
            n, n_lab, n_bad = len(rows), sum(lab.values()), sum(bad.values())
            for b in count:
                name = b
                if len(count) > 50:
                    name = "*"
                elif len(count) > 1:
                    free = len(rests) - 1
                    chi = 0
                    for c in rests:
                        for seen, size in ((cell[b, c], count[b]), (rests[c] - cell[b, c], n - count[b])):
                            want = size * rests[c] / n
                            chi += (seen - want) ** 2 / want
                    alike = free == 0 or chi <= free * (1 - 2 / (9 * free) + 1.645 * (2 / (9 * free)) ** 0.5) ** 3
                    if lab[b] and n_lab > lab[b]:
                        share = n_bad / n_lab
                        error = (share * (1 - share) * (1 / lab[b] + 1 / (n_lab - lab[b]))) ** 0.5
                        alike &= abs(bad[b] / lab[b] - (n_bad - bad[b]) / (n_lab - lab[b])) <= 1.96 * error
                    name = "~" if alike else b
                renamed[h, t, b] = f"{t}/{name}"
        for (h, s), t in list(template.items()):
            if len(s) > k:
                template[h, s] = renamed[h, t, s[k]]
    base = sum(v == "block" for *_, v in found) / max(1, len(found))
    by_host, by_template = defaultdict(list), defaultdict(list)
    for _, h, s, v in found:
        by_host[h].append(v)
        by_template[h, template[h, s]].append(v)
    out = {}
    for i, h, s, v in found:
        prior = (by_host[h].count("block") + 4 * base) / (len(by_host[h]) + 4)
        own = by_template[h, template[h, s]]
        purity = (own.count("block") + 4 * prior) / (len(own) - own.count(None) + 4)
        out[i] = v or ("block" if purity > 0.5 else "allow")
    return out


def word_grams(word, orders=(1, 2, 3), shift=48):
    """Buckets of a word's n-grams; what is no letter is a break, as are both ends."""
    points = [0, *(ord(c) if c.isalpha() else 0 for c in word.lower()), 0]
    out = []
    for order in orders:
        for at in range(len(points) - order + 1):
            gram = points[at : at + order]
            if any(gram) and all(gram[1:-1]):
                code = 0
                for p in gram:
                    code = code * 0x1F00D + p
                code = (code + (order << 56)) * 0xD6E8FEB86659FD93 % 2**64
                out.append(code >> shift)
    return out


def language_model(rows, buckets):
    """{language: log-likelihood of a bucket} from (text, lang) rows that have both."""
    counts = defaultdict(lambda: defaultdict(int))
    for text, lang in rows:
        if text is not None and lang is not None:
            for w in WORD.findall(text):
                for b in word_grams(w):
                    counts[lang][b] += 1
    totals = {x: sum(c.values()) for x, c in counts.items()}
    return {x: lambda b, x=x: math.log((counts[x].get(b, 0) + 0.1) / (totals[x] + 0.1 * buckets)) for x in sorted(counts)}


def language_mixture(model, text, steps, floor):
    """(language, score, size of the set): EM for a document's proportions, then the nested set of least penalised likelihood."""
    words = [w for w in WORD.findall(text or "") if any(c.isalpha() for c in w)]
    if not words or not model:
        return "und", 0.0, 0
    names, like = list(model), []
    for w in words:
        logs = [sum(model[x](b) for b in word_grams(w)) for x in names]
        p = [math.exp(max(v - max(logs), -50)) for v in logs]
        like.append([(1 - floor) * v / sum(p) + floor / len(names) for v in p])

    def fit(share, n):
        for _ in range(n):
            new = [0.0] * len(share)
            for p in like:
                total = sum(s * v for s, v in zip(share, p))
                new = [a + s * v / total / len(like) for a, s, v in zip(new, share, p)]
            share = new
        return share, sum(math.log(sum(s * v for s, v in zip(share, p))) for p in like)

    share, _ = fit([1 / len(names)] * len(names), steps)
    order, best = sorted(range(len(names)), key=lambda k: -share[k]), (math.inf, None, 0)
    for size in range(1, len(names) + 1):
        if size > 2 and best[2] != size - 1:
            break
        start = [share[k] + 1e-6 if k in order[:size] else 0.0 for k in range(len(names))]
        found, logs = fit([v / sum(start) for v in start], 0 if size == 1 else steps)
        best = min(best, (-2 * logs + size * math.log(len(words)), found, size), key=lambda c: c[0])
    top = max(range(len(names)), key=lambda k: best[1][k])
    return names[top], best[1][top], best[2]


def word_idf(texts):
    """Word: ln((1 + N) / (1 + texts that have it)) + 1."""
    df = Counter(w for t in texts for w in set(WORD.findall(t)))
    return {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}


def weighted_jaccard(a, b, idf, size=5):
    """Of two texts' word windows, each weighing its count times the mean idf of its words."""
    bags = []
    for t in (a, b):
        words = WORD.findall(t)
        bags.append(Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)))
    weight = lambda g: sum(idf[w] for w in g) / size
    both = bags[0].keys() | bags[1].keys()
    union = sum(max(bags[0][g], bags[1][g]) * weight(g) for g in both)
    return sum(min(bags[0][g], bags[1][g]) * weight(g) for g in both) / union if union else 0.0
