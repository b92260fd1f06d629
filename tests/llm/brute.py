"""Slow and plain versions of the corpus operators, for tests."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import regex
import xxhash

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sql(query, **tables):
    """The rows of a query over data frames, as a data frame."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(query).df()


def rows(df):
    """A multiset of a frame's rows with columns by name and nulls as None."""
    df = df[sorted(df.columns)]
    return Counter(tuple(None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else x.item() if hasattr(x, "item") else x for x in r) for r in df.itertuples(index=False))


def pieces(docs, tokenizer, capacity=4096, end=1):
    """Multiset of ``(doc_id, piece, start, length, crc)``."""
    out = Counter()
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        for piece, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            out[doc_id, piece, a, part.size, zlib.crc32(part.tobytes())] += 1
    return out


def repeats(docs, length):
    """``(doc_id, n_bytes, n_removed, n_spans, sha)`` by looking every window up."""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    out = Counter()
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(d) else 0
        rest = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[i, len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()] += 1
    return out


def _hash(form):
    h = xxhash.xxh64(form.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def forms(text):
    return [" ".join("<*>" if re.search("[0-9]", t) else t for t in WORD.findall(line)) for line in (text or "").split("\n")]


def _unrelated(pairs, sketches, min_docs, min_share):
    """``{(key, doc)}`` that recur, from ``(key, doc, line hash)``; ``sketches``: ``{doc: (hashes, rows)}``."""
    own = {}
    for key, doc, line in pairs:
        own[key, doc] = min(line, own.get((key, doc), line))
    members = defaultdict(list)
    for (key, doc), line in own.items():
        members[key].append((doc, [h for h in sketches[doc][0] if h != line] or [0]))
    out = set()
    for key, docs in members.items():
        held = Counter()
        for doc, others in docs:
            for h in others:
                held[h] += sketches[doc][1]
        counts = {}
        for doc, others in docs:
            ms = sorted(max(held[h], 1) for h in others)
            counts[doc] = ms[(len(ms) + 1) // 2 - 1]
        total = sum(sketches[doc][1] / counts[doc] for doc, _ in docs)
        if total >= min_docs - 1e-6:
            out |= {(key, doc) for doc, _ in docs if total >= min_share * counts[doc] - 1e-6}
    return out


def line_dedup(docs, min_docs=4, min_share=0.2, depth=3, agrees=0.75, sketch=8):
    """``{doc_id: text}`` without recurring lines; ids are distinct."""
    lines, rows = [], Counter()
    sketch_of = {}
    for i, text in docs:
        found = list(dict.fromkeys(f for f in forms(text) if f))
        doc = tuple(found)
        if found:
            rows[doc] += 1
            sketch_of[doc] = sorted(_hash(f) for f in found)[:sketch]
        lines += [(i, doc, f, tuple(f.split(" "))) for f in found]
    sketches = {doc: (s, rows[doc]) for doc, s in sketch_of.items()}
    leaf = lambda t: (len(t), *t[:depth])
    recurs = _unrelated([(f, doc, _hash(f)) for _, doc, f, _ in lines], sketches, min_docs, min_share)
    rest = [x for x in lines if len(x[3]) > depth and (x[2], x[1]) not in recurs]
    leaves = _unrelated([(leaf(t), doc, _hash(f)) for _, doc, f, t in rest], sketches, min_docs, min_share)
    busy = [x for x in rest if (leaf(x[3]), x[1]) in leaves]
    counts = Counter((leaf(t), k, token) for _, _, _, t in busy for k, token in enumerate(t[depth:]))
    fits = []
    for i, doc, f, t in busy:
        tail = t[depth:]
        for level in (4**k for k in range(1, 16)):
            stays = tuple((k, token) for k, token in enumerate(tail) if counts[leaf(t), k, token] >= level)
            if len(stays) >= agrees * len(tail):
                fits.append((i, doc, f, (leaf(t), stays)))
    general = _unrelated([(key, doc, _hash(f)) for _, doc, f, key in fits], sketches, min_docs, min_share)
    drop = {(i, f) for i, doc, f, _ in lines if (f, doc) in recurs} | {(i, f) for i, doc, f, key in fits if (key, doc) in general}
    return {i: None if text is None else "\n".join(x for x, f in zip(text.split("\n"), forms(text), strict=True) if (i, f) not in drop) for i, text in docs}


def chat(messages):
    """Multiset of ``(conv, turn, role, reply_to, root, depth, content)`` from ``(conv, turn, role, text)`` without nulls in the keys."""
    quote = re.compile(r"^[\x20\x09]*(>[\x20\x09]*)+")

    def passages(text):
        run, level = [], None
        for line in [*re.split(r"\r?\n", text or ""), ""]:
            m = quote.match(line)
            depth, body = (m[0].count(">"), line[m.end() :]) if m else (0, line)
            blank = not regex.search(r"[\p{L}\p{N}]", body)
            if run and (blank or depth != level):
                yield level, regex.sub(r"[^\p{L}\p{N}]+", " ", " ".join(run).lower()).strip(" ")
                run = []
            if not blank:
                level = depth
                run.append(body)

    said, out = defaultdict(dict), Counter()
    found = [(c, t, list(passages(text))) for c, t, _, text in messages]
    for c, t, parts in found:
        for level, p in parts:
            if level == 0:
                said[c][p] = min(t, said[c].get(p, t))
    reply = {}
    for c, t, parts in found:
        at = [said[c][p] for level, p in parts if level == 1 and said[c].get(p, t) < t]
        if at:
            reply[c, t] = max([*at, reply.get((c, t), at[0])])
    for c, t, role, text in messages:
        root, depth = t, 0
        while (c, root) in reply:
            root, depth = reply[c, root], depth + 1
        own = "\n".join(x for x in re.split(r"\r?\n", text or "") if not quote.match(x))
        out[c, t, (role or "user").lower(), reply.get((c, t)), root, depth, f"<|{(role or 'user').lower()}|>\n" + re.sub(r"\n{3,}", "\n\n", own).strip(" \t\r\n")] += 1
    return out


def greedy_pieces(word, vocabulary):
    n = at = 0
    while at < len(word):
        end = len(word)
        while word[at:end] not in vocabulary:
            end -= 1
            if end == at:
                return 1
        at, n = end, n + 1
    return n


def mixed(docs, takes):
    """``(doc_id, text)`` of the mix in each source's stream: ``docs`` with ``(doc_id, text, source)``, ``takes`` words by source."""
    out, streams = [], defaultdict(list)
    for i, text, source in docs:
        size = len(WORD.findall(text or ""))
        if size:
            streams[source].append((hashlib.md5(f"mix{i}".encode()).hexdigest(), i, size, text))
        else:
            out.append((i, text))
    for source, stream in streams.items():
        at = 0
        for _ in range(3):
            for _, i, size, text in sorted(stream):
                if at < takes[source] and 2 * (takes[source] - at) >= size:
                    out.append((i, text))
                at += size
    return out
