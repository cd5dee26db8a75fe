"""Plain loops for what the operators compute."""

import hashlib
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def solid(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def wordy(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, n=3):
    w = solid((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def groups(rows, part=90, n=3):
    """doc_id -> (size, smallest linked id)."""
    sets = {d: shingles(t, n) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= part * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in sets}


def contamination(rows, items, window=10):
    patterns = {}
    for item, text in items:
        w = wordy(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            patterns.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for d, text, *_ in rows:
        w, hit, found = wordy(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                own = patterns.get(tuple(w[i : i + k]))
                if own:
                    hit.update(range(i, i + k))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def token_rows(rows, path, end=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out, start = [], 0
    for d, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def repeats(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of what stays)."""
    seen, gone = {}, {}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, text, *_ in ordered:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            first = seen.setdefault(data[i : i + length], (d, i))
            if first != (d, i):
                gone.setdefault(d, set()).update(range(i, i + length))
    out = []
    for d, text, *_ in ordered:
        data, cut = (text or "").encode(), gone.get(d, set())
        kept = bytes(b for i, b in enumerate(data) if i not in cut)
        runs = sum(i - 1 not in cut for i in cut)
        out.append((d, len(data), len(cut), runs, hashlib.sha256(kept).hexdigest()))
    return out


def surface(text):
    text = text or ""
    w = solid(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(solid(line)) and line in seen
        seen.add(line)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base_phrases(text):
    w = wordy(text)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_secrets(text):
    text = text or ""
    spans = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = {"assign": 0, "access": 1, "hex": 2}
    spans.sort(key=lambda x: (x[1].start(), rank[x[0]]))
    counts = [sum(k == kind for k, _ in spans) for kind in rank]
    joined = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in spans)
    return (*counts, hashlib.sha256(joined.encode()).hexdigest(), joined)


def counted_words(rows):
    """word -> occurrences, of at least five letters and three occurrences."""
    out = Counter()
    for d, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants(words):
    """(word, form, root, n, n_near, form_n) by comparing words that share what is left without a letter."""
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: set() for w in words}
    for key, group in holes.items():
        for w in group:
            near[w] |= {x for x in group if one_edit(w, x)}
            if key in near and one_edit(w, key):
                near[w].add(key)
                near[key].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def infilled(doc_id, text, seed=1):
    """(n, form, prefix, middle, suffix, output)."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def chat_turns(rows):
    """conv_id -> [(role, text)] in order, of (conv_id, turn, role, text) rows."""
    out = {}
    lead = lambda x: (x is not None, x if x is not None else 0)
    for c, _, role, text in sorted(rows, key=lambda r: (lead(r[0]), lead(r[1]), (r[2] is not None, r[2] or ""), r[3] or "")):
        out.setdefault(c, []).append((role, text or ""))
    return out


def chat_text(turns, learned=("assistant",)):
    """(formatted text, irregular turns, state at the end) by a plain walk; texts must hold no control string."""
    state, out, odd = "start", [], 0
    for role, text in turns:
        if role == "system" and state == "start":
            out.append(f"<<SYS>>\n{text}\n<</SYS>>\n")
        elif role == "user" and state != "user":
            out.append(f"<s>[INST] {text} [/INST]")
        elif role == "assistant" and state == "user":
            out.append(f" {text}</s>")
        else:
            odd += 1
            out.append(f"[ROLE]{role or ''}[/ROLE] {text}</s>")
        state = role if role in ("system", "user", "assistant") else state
    return "".join(out), odd, state
