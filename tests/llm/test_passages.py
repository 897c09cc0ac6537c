import random
import re
from collections import Counter, defaultdict

from evidra.llm import passages, shingles

from . import frames


def units(text, least):
    """(first word, one past the last, start, stop, words) of each unit, word by word."""
    found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\w+", text)]
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append([i for i, w in enumerate(found) if at <= w[0] < at + len(line)])
        at += len(line) + 1
    pieces, short = [], []
    for mine in lines:
        if len(mine) >= least:
            pieces += [short, mine]
            short = []
        else:
            short = short + mine
    out = []
    for piece in [*pieces, short]:
        if len(piece) < least:
            continue
        hashed = [shingles.word_hashes(found[i][2].encode())[0] for i in piece]
        pair = [int(shingles.mix(h + shingles.mix(n) if n is not None else h)[0]) for h, n in zip(hashed, [*hashed[1:], None])]
        cuts = [0]
        for i in range(least, len(piece) - least + 1):
            if all(pair[i] < pair[i + d] and pair[i] < pair[i - d] for d in range(1, least)):
                cuts.append(i)
        for a, b in zip(cuts, [*cuts[1:], len(piece)]):
            a, b = piece[a], piece[b - 1] + 1
            stop = found[b - 1][1]
            while stop < len(text) and text[stop].isascii() and text[stop] not in " \t\n\x0b\x0c\r" and not (b < len(found) and stop == found[b][0]):
                stop += 1
            out.append((a, b, found[a][0], stop, tuple(w[2] for w in found[a:b])))
    return found, out


def brute(rows, run_words=0, least=8):
    docs = {}
    for k, text in rows:
        docs.setdefault(k, units(text or "", least))
    first = {}
    for k in sorted(docs, key=lambda k: (k is not None, k or 0)):
        for u in docs[k][1]:
            first.setdefault(u[4], (k, u[0], u[2]))
    out = []
    for k, (found, mine) in docs.items():
        runs = []
        for u in mine:
            if first[u[4]][:2] != (k, u[0]):
                if runs and runs[-1][-1][1] == u[0]:
                    runs[-1].append(u)
                else:
                    runs.append([u])
        grown = []
        for run in runs:
            a, b, stop = run[0][0], run[-1][1], run[-1][3]
            kk, i, ks = first[run[0][4]]
            theirs = docs[kk][0]
            while a > 0 and i > 0 and found[a - 1][2] == theirs[i - 1][2]:
                a, i, ks = a - 1, i - 1, theirs[i - 1][0]
            tk, j, _ = first[run[-1][4]]
            j += len(run[-1][4])
            while b < len(found) and j < len(docs[tk][0]) and found[b][2] == docs[tk][0][j][2]:
                b, j, stop = b + 1, j + 1, found[b][1]
            grown.append([a, b, found[a][0] if a < run[0][0] else run[0][2], stop, kk, ks])
        merged = []
        for g in sorted(grown, key=lambda g: (g[2], g[3])):
            if merged and g[0] <= merged[-1][1]:
                merged[-1][1], merged[-1][3] = max(merged[-1][1], g[1]), max(merged[-1][3], g[3])
            else:
                merged.append(g)
        out += [(k, g[2], g[3] - g[2], g[1] - g[0], g[4], g[5]) for g in merged if g[1] - g[0] >= run_words]
    return sorted(out, key=repr)


def sentence(rng, n):
    return " ".join(rng.choice("river stone light walk house green small far old new".split()) + str(rng.randrange(300)) for _ in range(n)).capitalize() + "."


def test_like_brute_force(spark):
    rng = random.Random(12)
    shared = [" ".join(sentence(rng, 9) for _ in range(7)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(2, 14)) for _ in range(12)]
        for _ in range(i % 3):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared).upper() if i % 4 == 0 else rng.choice(shared))
        rows.append((i * 3 + 1, rng.choice((" ", "\n")).join(parts)))
    rows.append((500, rows[3][1]))
    df = frames.docs(spark, rows)
    got = sorted((tuple(r) for r in passages.repeated_passages(df).collect()), key=repr)
    assert got == brute(rows) and len(got) > 20
    kept = {r.row.doc_id: r.kept for r in passages.without_passages(df, passages.repeated_passages(df)).collect()}
    whole = dict(rows)
    spans = defaultdict(list)
    for d, start, length, *_ in got:
        spans[d].append((start, length))
    for d, text in whole.items():
        for start, length in sorted(spans[d], reverse=True):
            text = text[:start] + text[start + length:]
        assert kept[d] == text


def test_awkward_rows(spark):
    spaced = "One two three four five six.  Seven eight nine ten eleven. " * 6
    rows = [(r[0], r[1]) for r in frames.EDGE if r[0] not in (None, 7)] + [(40, spaced), (41, spaced.replace(" ", "  ")), (42, None)]
    got = sorted((tuple(r) for r in passages.repeated_passages(frames.docs(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    every = frames.docs(spark, frames.EDGE)
    spans = passages.repeated_passages(every)
    assert passages.without_passages(every, spans).count() == len(frames.EDGE)
    assert passages.repeated_passages(frames.docs(spark, [])).collect() == []


def brute_by_text(rows):
    """``brute`` with every different text of a key as a document of its own, in the order of the keys."""
    texts = list(dict.fromkeys(rows))
    numbers = {i: k for i, (k, _) in enumerate(texts)}
    return sorted(((numbers[d], start, n, words, numbers[kd], ks) for d, start, n, words, kd, ks in brute([(i, t) for i, (_, t) in enumerate(texts)])), key=repr)


def test_rows_that_share_a_key(spark):
    six = " ".join(f"Row{i} has ten words in a row and no more." for i in range(6))
    rows = [(r[0], r[1]) for r in frames.EDGE] + [(50, six), (51, six), (51, six), (52, six + " Other words here too."), (52, "Its own beginning is here. " + six)]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted((tuple(r) for r in passages.repeated_passages(frames.docs(spark, rows)).collect()), key=repr)
    assert got == brute_by_text(rows) and sum(r[3] >= 30 for r in got) == 5
    nameless = [(None, six), (None, "Its own beginning is here. " + six), (7, "A row of four words. " + six)]
    df = frames.docs(spark, nameless)
    kept = [r.kept for r in passages.without_passages(df, passages.repeated_passages(df, by_text=True)).collect()]
    assert sum(six in t for t in kept) == 1 and sorted(len(t) for t in kept)[:2] == [21, 27]


def test_passages_inside_sentences(spark):
    rng = random.Random(31)
    word = lambda: rng.choice("river stone light walk house green small far old new".split()) + str(rng.randrange(3000))
    passage = [word() for _ in range(55)]
    broken = " ".join(w + ("." if i in (9, 24, 40) else "") for i, w in enumerate(passage))  # begins and ends inside sentences
    own = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, f"{own(12)} {broken} {own(9)}. {own(30)}."), (2, f"{own(5)} {broken} {own(14)}."), (3, f"{own(40)} {' '.join(passage)} {own(35)}."),
            (4, f"{own(70)} {' '.join(passage)} {own(20)}."), (5, f"{own(30)}.")]
    whole = dict(rows)
    got = {(r.doc_id, whole[r.doc_id][r.start:r.start + r.length]): r for r in passages.repeated_passages(frames.docs(spark, rows)).collect()}
    assert set(got) == {(2, broken), (3, " ".join(passage)), (4, " ".join(passage))}
    assert got[2, broken].words == 55 and got[2, broken].kept_doc_id == 1 and got[2, broken].kept_start == whole[1].index(broken)


def test_runs_that_begin_anywhere(spark, monkeypatch):
    """Parts, extension over several rounds, repeats inside one document, letters beyond ASCII, lines of a word each."""
    rng = random.Random(77)
    vocabulary = [w + str(i) for i in range(40) for w in "fluß été straße öl ÉTÉ maß Ünder ça rio a".split()] + ["İz", "ﬁn"]
    word = lambda: rng.choice(vocabulary)
    long = [[word() for _ in range(n)] for n in (50, 80, 140, 60, 400)]
    joins = [" ", " ", " ", ", ", "\n", "!! ", "\u00a0", "\u3000– ", ".\t"]
    rows = []
    for i in range(40):
        words = [word() for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 4)):
            words += rng.choice(long) + [word() for _ in range(rng.randrange(1, 25))]
        few = rng.sample(joins, rng.randrange(1, 4))
        rows.append((i, "".join(w + rng.choice(few) for w in words)))
    rows += [(100, "\n".join(long[1])), (101, "\n".join(long[1]) + "\nown\n" + " ".join(long[1])), (102, "one two three four five six seven eight " * 30)]
    monkeypatch.setattr(passages, "FIRST_LOOK", 5)
    monkeypatch.setattr(passages, "STEP", 3000)
    got = sorted((tuple(r) for r in passages.repeated_passages(frames.docs(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    few = sorted((tuple(r) for r in passages.repeated_passages(frames.docs(spark, rows), run_words=60).collect()), key=repr)
    assert few == brute(rows, 60) and 0 < len(few) < len(got)
    gone = Counter(d for d, *_ in got)
    texts = dict(rows)
    places = {k: [(m.start(), m.group().lower()) for m in re.finditer(r"\w+", t)] for k, t in texts.items()}
    seen, whole, runs = set(), 0, 0
    for k, words in places.items():  # nearly every run of 50 words that an earlier place has loses words
        for i in range(len(words) - 49):
            run = tuple(w for _, w in words[i:i + 50])
            if run in seen and len(set(run)) >= 20:
                runs += 1
                whole += not any(d == k and start < words[i + 49][0] and words[i][0] < start + length for d, start, length, *_ in got)
            seen.add(run)
    assert whole < 0.02 * runs and len(gone) > 20
