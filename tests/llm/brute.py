"""Plain versions of the contracts, for small tables."""

import functools
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base(text):
    w = words(text)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeat = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(repeat)


def shingles(text, k=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_components(docs, k=5, percent=80):
    sets = {d: shingles(t, k) for d, t in docs.items()}
    up = {d: d for d in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in where.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {d: (len(sets[d]), top(d)) for d in docs}


def remove_repeats(docs, window=20):
    first = {}
    for d in sorted(docs):
        w = words(docs[d])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, text in docs.items():
        w = words(text)
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (d, i) for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def dedup_lines(docs):
    """docs: distinct (doc_id, text). Lines of two-line windows that occur before go."""
    first, out = {}, {}
    for d in sorted(docs):
        lines = docs[d].split("\n")
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            first.setdefault(pair, (d, i))
    for d, text in docs.items():
        lines = text.split("\n")
        gone = {i + j for i, pair in enumerate(zip(lines, lines[1:], strict=False)) if first[pair] != (d, i) for j in (0, 1)}
        out[d] = len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def conversations(rows, null=""):
    """conv_id: its (turn, role, text) in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, null if role is None else role, null if text is None else text))
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for k, v in out.items()}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (kind != 0) * (1 + (kind == 3))
    return out


def repair(turns):
    """turns of one conversation after damage, in order: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)."""
    space, faults, seen = " \t\n\v\f\r", [], set()
    for _, role, text in turns:
        bare = text.rstrip(space)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, state, inserts):
        """The cheapest rest: (cost, audit, repaired)."""
        found = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        options = []
        if inserts < 3:
            options += [(5, "I", to, i, inserts + 1, (f"{names[to]}:",)) for (s, _), to in step.items() if s == state and to in names]
        if i < len(turns):
            _, role, text = turns[i]
            options.append((2, "D", state, i + 1, 0, ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if (state, role[:1]) in step:
                    options.append((more, "K", step[state, role[:1]], i + 1, 0, (f"{role}:{text}",)))
                options += [(1 + more, "R", to, i + 1, 0, (f"{names[to]}:{text}",)) for (s, _), to in step.items() if s == state and to in names]
        for cost, op, to, j, k, lines in options:
            rest = best(j, to, k)
            if rest is not None:
                found.append((cost + rest[0], op + rest[1], lines + rest[2]))
        return min(found, default=None)

    cost, audit, lines = best(0, "", 0)
    initials = [r[:1] for _, r, _ in turns]
    at = {t for t, _, _ in turns if t is not None}
    gaps = max(at) - min(at) + 1 - len(at) if at else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def rebuilt(rows):
    """conv_id: its rebuilt (role, text)."""
    own = {k: [x[1:] for x in v] for k, v in conversations(rows).items() if k is not None}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = own.get(conv - conv % 5, [])[:h] + turns[h:]
    return out


def trie(convs):
    """convs: conv_id: list of (role, text). {(smallest member, depth): (parent, n_convs, n_children, n_leaves, saved, ends sha)}"""
    members = {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = {}
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        leaves = sum(x not in kids for x in below)
        ends = ",".join(map(str, sorted(w for w in who if len(convs[w]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out[min(who), len(node)] = parent, len(who), len(kids.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()
    return out
