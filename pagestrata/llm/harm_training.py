"""Trains the weights of the harm classifier.

    python -m pagestrata.llm.harm_training FOLDER_OF_TABLES [OUT]
    python -m pagestrata.llm.harm_training FOLDER_OF_TABLES --hold-out

Rows: the sentences of ``harm_seed`` with their slots filled, disguised at random; windows of documents that
most reviewers found harmless, at random and those that a first model mistakes; and of each document that most
found harmful the window whose words come with that label, or else the one that the model before scores highest. At most ``LABELLED`` labelled documents are used,
the first by a hash of their id. With --hold-out a model is trained without a fifth of the sources, a fifth of the
seeds and the labelled documents beyond the sample, and what it finds in these is printed.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import xxhash

from pagestrata.llm import harm_seed as S
from pagestrata.llm.harm import ATTENTION, BUCKETS, CATEGORIES, CHAR_DIM, STATES, THRESHOLD, WEIGHTS, WORD_DIM, Scorer, sentences, sigmoid, windows, word_ids

LABELLED, CLEAN_WINDOWS, HARD_WINDOWS, FILLED, COPIES, ROUNDS, BATCH, RATE = 4000, 50000, 10000, 30, 10, (3, 4, 8), 64, 0.004
AGREED, AGREED_ON = 0.6, 4
_LEET = {"a": "4@", "e": "3", "i": "1!", "o": "0", "s": "5$", "t": "7"}
_ALIKE = dict(zip("aeopcyx", "аеорсух"))
_GROUP_ENDS = ["ites", "ians", "ish", "ese", "ers", "i", "en", "folk", "iten", "er", "os", "ы", "цы", ""]


def name(rng: random.Random) -> str:
    """An invented word of two to four syllables."""
    return "".join(rng.choice("bcdfghjklmnprstvwxz") + rng.choice(["", "", "l", "r"]) + rng.choice(["a", "e", "i", "o", "u", "ae", "or", "en", "il"]) for _ in range(rng.randint(2, 4)))


def group(rng: random.Random) -> str:
    return rng.choice(S.GROUP_FORMS).format(g=name(rng).capitalize() + rng.choice(_GROUP_ENDS))


def fill(template: str, rng: random.Random) -> str:
    out = template
    while "{" in out:
        out = (
            out.replace("{N}", rng.choice(S.INSULT), 1).replace("{A}", rng.choice(S.ADJECTIVE), 1).replace("{U}", "@" + name(rng), 1)
            .replace("{T}", rng.choice(S.TEAM), 1).replace("{G}", group(rng), 1).replace("{C}", f"`{name(rng)}_{rng.choice(['size', 'limit', 'mode'])}`", 1)
            .replace("{W}", rng.choice([name(rng) + ".example", name(rng)]), 1).replace("{D}", str(rng.randint(2, 400)), 1)
        )
    return rng.choice(["", "", "", "// ", "# ", "> ", "TODO: ", "<!-- ", f"**@{name(rng)}** wrote: "]) + out


def disguise(text: str, rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.45:
        return text if kind < 0.35 else text.upper()
    if kind < 0.55:
        return "".join(_ALIKE.get(c, c) if rng.random() < 0.8 else c for c in text)
    words = text.split(" ")
    for i in range(len(words)):
        w = words[i]
        if len(w) < 3 or not w.isalpha() or not w.isascii() or rng.random() < 0.6:
            continue
        if kind < 0.68:
            words[i] = "".join(rng.choice(_LEET[c]) if c in _LEET and rng.random() < 0.6 else c for c in w)
        elif kind < 0.78:
            words[i] = rng.choice([" ", ".", "-"]).join(w)
        elif kind < 0.9:
            words[i] = w[0] + "*" * (len(w) - 2) + w[-1]
        else:
            words[i] = w + w[-1] * rng.randint(1, 3)
    return " ".join(words)


def seed_rows(rng: random.Random, without: int | None = None) -> list[tuple[tuple[str, ...], int]]:
    """The windows of the filled seeds with their labels; every fifth seed is left out if ``without`` is its rest."""
    rows = []
    for label, templates in ((1, S.ABUSIVE), (2, S.HATEFUL), (3, S.SEXUAL), (0, S.HARMLESS)):
        for k, template in enumerate(templates):
            for _ in range(FILLED if k % 5 != without else 0):
                text = fill(template, rng)
                rows += [(w, label) for w in windows(disguise(text, rng) if label else text if rng.random() < 0.8 else text.upper())]
    return rows


def plain_rows(windows_of_documents: list[tuple[str, ...]], rng: random.Random) -> list[tuple[tuple[str, ...], int]]:
    """Short pieces of harmless windows, and rows of invented names and identifiers: brevity is no harm."""
    out = []
    for words in windows_of_documents:
        if len(words) > 2:
            low = rng.randrange(len(words) - 1)
            out.append((words[low : low + rng.randint(1, 5)], 0))
    for _ in range(3000):
        out.append((tuple(rng.choice([name(rng), f"{name(rng)}_size", "codespan", "#", "@", "".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(2, 9)))]) for _ in range(rng.randint(1, 6))), 0))
    return out


def labelled(folder: str) -> list[tuple[str | None, str, tuple[int, ...]]]:
    """The sources, texts and majority labels of the labelled documents in order of a hash of their ids.

    Each reviewer has one vote, the last; -1 is a tie or no vote.
    """
    labels = pq.read_table(f"{folder}/doc_labels.parquet").to_pylist()
    votes: dict[int, dict] = defaultdict(dict)
    for r in sorted(labels, key=lambda r: str(r["reviewed_at"])):
        if r["doc_id"] is not None:
            votes[r["doc_id"]][r["reviewer"]] = [r[c] for c in CATEGORIES]
    out = {}
    for doc, by in votes.items():
        shares = [[v[k] for v in by.values() if v[k] is not None] for k in range(len(CATEGORIES))]
        out[doc] = tuple(-1 if not s else 1 if 2 * sum(s) > len(s) else 0 if 2 * sum(s) < len(s) else -1 for s in shares)
    documents = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "source", "text"]).to_pylist()
    held = {d["doc_id"]: (d["source"], d["text"], out[d["doc_id"]]) for d in documents if d["doc_id"] in out and d["text"]}
    return [held[k] for k in sorted(held, key=lambda k: xxhash.xxh3_64_intdigest(str(k)))]


def start(seed: int) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, STATES
    draw = lambda *shape: g.normal(0, 1 / np.sqrt(shape[0]), shape)
    return {
        "words": g.normal(0, 0.3, (BUCKETS, WORD_DIM)), "grams": g.normal(0, 0.5, (BUCKETS, CHAR_DIM)),
        "wf": draw(d, 3 * h), "bf": np.zeros(3 * h), "uf": draw(h, 3 * h), "wb": draw(d, 3 * h), "bb": np.zeros(3 * h), "ub": draw(h, 3 * h),
        "wa": draw(2 * h, ATTENTION), "va": draw(ATTENTION), "wo": draw(2 * h, 1 + len(CATEGORIES)), "bo": np.zeros(1 + len(CATEGORIES)),
    }


def _gru(x: np.ndarray, u: np.ndarray):
    n, steps, h3 = x.shape
    k = h3 // 3
    h, kept, out = np.zeros((n, k)), [], np.empty((n, steps, k))
    for t in range(steps):
        a = h @ u
        z, r = sigmoid(x[:, t, :k] + a[:, :k]), sigmoid(x[:, t, k : 2 * k] + a[:, k : 2 * k])
        m = np.tanh(x[:, t, 2 * k :] + r * a[:, 2 * k :])
        kept.append((h, z, r, m, a[:, 2 * k :]))
        h = (1 - z) * m + z * h
        out[:, t] = h
    return out, kept


def _gru_back(dout: np.ndarray, kept: list, u: np.ndarray):
    n, steps, k = dout.shape
    dx, du, dh = np.empty((n, steps, 3 * k)), np.zeros_like(u), np.zeros((n, k))
    for t in range(steps - 1, -1, -1):
        h, z, r, m, an = kept[t]
        dh = dh + dout[:, t]
        dm = dh * (1 - z) * (1 - m * m)
        dz = dh * (h - m) * z * (1 - z)
        dr = dm * an * r * (1 - r)
        dx[:, t, :k], dx[:, t, k : 2 * k], dx[:, t, 2 * k :] = dz, dr, dm
        da = np.concatenate([dz, dr, dm * r], axis=1)
        du += h.T @ da
        dh = dh * z + da @ u.T
    return dx, du


def gradients(w: dict[str, np.ndarray], batch: list[tuple], labels: np.ndarray, weight: np.ndarray):
    """The loss, and its gradients, of windows of one length given as word buckets and trigram buckets."""
    n, steps = len(batch), len(batch[0])
    d = WORD_DIM + CHAR_DIM
    words = np.array([[b for b, _ in row] for row in batch])
    grams = [g for row in batch for _, g in row]
    sizes = np.array([len(g) for g in grams])
    flat = np.concatenate([np.array(g) for g in grams])
    owner = np.repeat(np.arange(n * steps), sizes)
    mean = np.zeros((n * steps, CHAR_DIM))
    np.add.at(mean, owner, w["grams"][flat])
    mean /= sizes[:, None]
    x = np.concatenate([w["words"][words.ravel()], mean], axis=1)
    forward, kf = _gru((x @ w["wf"] + w["bf"]).reshape(n, steps, -1), w["uf"])
    backward, kb = _gru((x @ w["wb"] + w["bb"]).reshape(n, steps, -1)[:, ::-1], w["ub"])
    h = np.concatenate([forward, backward[:, ::-1]], axis=2)
    s = np.tanh(h @ w["wa"])
    e = s @ w["va"]
    a = np.exp(e - e.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,ntk->nk", a, h)
    y = pooled @ w["wo"] + w["bo"]
    y = np.exp(y - y.max(axis=1, keepdims=True))
    y /= y.sum(axis=1, keepdims=True)
    loss = -(weight * np.log(y[np.arange(n), labels] + 1e-9)).sum()
    dy = y.copy()
    dy[np.arange(n), labels] -= 1
    dy *= weight[:, None] / n
    g = {"wo": pooled.T @ dy, "bo": dy.sum(axis=0)}
    dp = dy @ w["wo"].T
    da = np.einsum("nk,ntk->nt", dp, h)
    de = a * (da - (a * da).sum(axis=1, keepdims=True))
    ds = de[:, :, None] * w["va"] * (1 - s * s)
    g["va"] = np.einsum("nt,nta->a", de, s)
    g["wa"] = np.einsum("ntk,nta->ka", h, ds)
    dh = a[:, :, None] * dp[:, None, :] + ds @ w["wa"].T
    dxf, g["uf"] = _gru_back(dh[:, :, :STATES], kf, w["uf"])
    dxb, g["ub"] = _gru_back(dh[:, ::-1, STATES:], kb, w["ub"])
    dxf, dxb = dxf.reshape(n * steps, -1), dxb[:, ::-1].reshape(n * steps, -1)
    g["wf"], g["bf"], g["wb"], g["bb"] = x.T @ dxf, dxf.sum(axis=0), x.T @ dxb, dxb.sum(axis=0)
    dx = dxf @ w["wf"].T + dxb @ w["wb"].T
    touched_words, inverse = np.unique(words.ravel(), return_inverse=True)
    gw = np.zeros((len(touched_words), WORD_DIM))
    np.add.at(gw, inverse, dx[:, :WORD_DIM])
    touched_grams, inverse = np.unique(flat, return_inverse=True)
    gg = np.zeros((len(touched_grams), CHAR_DIM))
    np.add.at(gg, inverse, (dx[:, WORD_DIM:d] / sizes[:, None])[owner])
    g["words"], g["grams"] = (touched_words, gw), (touched_grams, gg)
    return loss, g


def train(rows: list[tuple[tuple[str, ...], int]], epochs: int = 9, seed: int = 5, say=print) -> dict[str, np.ndarray]:
    """Adam over batches of windows of one length; words are dropped at random so that single ones don't decide."""
    rng, w = random.Random(seed), start(seed)
    known: dict[str, tuple] = {}
    coded = [([known.setdefault(x, word_ids(x)) for x in words], y) for words, y in rows if words]
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    counts = Counter(y for _, y in coded)
    balance = np.array([(len(coded) / (4 * max(1, counts[y]))) ** 0.5 for y in range(1 + len(CATEGORIES))])
    void = (0, word_ids("")[1])
    for epoch in range(epochs):
        by_length: dict[int, list] = defaultdict(list)
        for words, y in coded:
            by_length[len(words)].append((words, y))
        batches = []
        for same in by_length.values():
            rng.shuffle(same)
            batches += [same[i : i + BATCH] for i in range(0, len(same), BATCH)]
        rng.shuffle(batches)
        total, rate = 0.0, RATE * (1 - epoch / epochs) + 1e-4
        for part in batches:
            step += 1
            labels = np.array([y for _, y in part])
            dropped = [[(b if rng.random() > 0.25 else 0, g) if rng.random() > 0.04 else void for b, g in words] for words, _ in part]
            loss, g = gradients(w, dropped, labels, balance[labels])
            total += loss
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, grad in g.items():
                at, grad = grad if isinstance(grad, tuple) else (slice(None), grad)
                first[k][at] = 0.9 * first[k][at] + 0.1 * grad
                second[k][at] = 0.999 * second[k][at] + 0.001 * grad * grad
                w[k][at] -= rate * fix * first[k][at] / (np.sqrt(second[k][at]) + 1e-8)
        say(f"epoch {epoch}: loss {total / len(coded):.4f}", flush=True)
    return w


def _runs(window: tuple[str, ...]) -> set[tuple[str, ...]]:
    return {window[i : i + 3] for i in range(len(window) - 2)}


def agreed_windows(documents: list[tuple]) -> tuple[list[tuple[tuple[str, ...], int]], list[tuple]]:
    """A window of each harmful document whose runs of three words come with that label, and the documents without one.

    Reviewers err and confuse categories, so a run says as much as the share of the documents with it that most
    found to hold the category, two more that didn't added, so that few documents say little: it must be on
    ``AGREED_ON`` labelled documents, and in no other category more often.
    """
    found = [(windows(text), labels) for _, text, labels in documents]
    on: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0] * (1 + len(CATEGORIES)))
    for parts, labels in found:
        for run in set().union(*map(_runs, parts)) if parts else ():
            count = on[run]
            count[0] += 1
            for k, value in enumerate(labels):
                count[1 + k] += value == 1
    agreed, left = [], []
    for (parts, labels), document in zip(found, documents):
        taken = []
        for k, value in enumerate(labels):
            if value == 1:
                shares = [(max((on[r][1 + k] / (on[r][0] + 2) for r in _runs(w) if on[r][0] >= AGREED_ON and on[r][1 + k] == max(on[r][1:])), default=0), w) for w in parts]
                share, window = max(shares, key=lambda x: x[0], default=(0, ()))
                if share >= AGREED:
                    taken.append((window, 1 + k))
        agreed += taken
        if not taken and any(v == 1 for v in labels):
            left.append(document)
    return agreed, left


def rows_of_documents(documents: list[tuple], agreed: list[tuple], left: list[tuple], scorer: Scorer, rng: random.Random) -> list[tuple[tuple[str, ...], int]]:
    """Windows of the documents most found harmless, and of the harmful ones those agreed on or else the highest scored.

    A document without a window of the category by the model is no example, and a window of a harmless document
    that the model is sure of is none either, as reviewers miss things.
    """
    clean, harmful = [], list(agreed)
    for _, text, labels in documents:
        if not any(labels) and (found := windows(text)):
            p = scorer.score(found)
            clean += [(1 - y, window) for y, window in zip(p[:, 0], found) if y > 0.1]
    for _, text, labels in left:
        if found := windows(text):
            p = scorer.score(found)
            for k, value in enumerate(labels):
                best = int(p[:, 1 + k].argmax())
                if value == 1 and p[best, 1 + k] > 0.5 and p[best].argmax() == 1 + k:
                    harmful.append((found[best], 1 + k))
    rng.shuffle(clean)
    hard = sorted(clean[CLEAN_WINDOWS:], key=lambda c: -c[0])[:HARD_WINDOWS]
    again = [(w, label) for window, label in harmful for k in range(COPIES) for w in (windows(disguise(" ".join(window), rng)) if k % 2 else [window])]
    return [(x, 0) for _, x in clean[:CLEAN_WINDOWS] + hard] + again


def fit(documents: list[tuple], without: int | None = None, say=print) -> dict[str, np.ndarray]:
    """The weights after rounds of the seeds and harmless windows, and then of what the model before finds."""
    rng = random.Random(3)
    rows = seed_rows(rng, without)
    some = [x for _, text, labels in documents if not any(labels) for x in windows(text)]
    rng.shuffle(some)
    say(len(rows), "filled sentences,", len(some), "harmless windows", flush=True)
    rows += plain_rows(some[:CLEAN_WINDOWS], rng)
    agreed, left = agreed_windows(documents)
    say(Counter(y for _, y in agreed), "windows agreed on,", len(left), "documents without one", flush=True)
    model = train(rows + [(x, 0) for x in some[:CLEAN_WINDOWS]] + agreed * COPIES, epochs=ROUNDS[0], say=say)
    for epochs in ROUNDS[1:]:
        more = rows_of_documents(documents, agreed, left, Scorer(model), rng)
        say(Counter(y for _, y in more), flush=True)
        model = train(rows + more, epochs=epochs, say=say)
    return model


def found_in(documents: list[tuple], scorer: Scorer) -> dict[str, tuple[int, int, int]]:
    """Of each category: documents that most found to hold it, those of them that score above the threshold, and harmless ones that do."""
    top, _ = scorer.top([text for _, text, _ in documents])
    labels = np.array([labels for *_, labels in documents])
    over, none = top > THRESHOLD, (labels == 0).all(axis=1)
    return {c: (int((labels[:, k] == 1).sum()), int((over[:, k] & (labels[:, k] == 1)).sum()), int((over[:, k] & none).sum())) for k, c in enumerate(CATEGORIES)}


def hold_out(folder: str) -> None:
    """Trains without a fifth of the sources and of the seeds, and prints what is found in these and beyond the sample."""
    documents = labelled(folder)
    apart = {s for s in {source for source, *_ in documents} if xxhash.xxh3_64_intdigest(str(s)) % 5 == 0}
    scorer = Scorer(fit([d for d in documents[:LABELLED] if d[0] not in apart], without=0))
    print("labelled, found, and harmless ones found:")
    print("documents of sources left out", found_in([d for d in documents if d[0] in apart], scorer))
    print("documents beyond the sample", found_in([d for d in documents[LABELLED:] if d[0] not in apart], scorer))
    rng = random.Random(77)
    for label, templates in ((1, S.ABUSIVE), (2, S.HATEFUL), (3, S.SEXUAL), (0, S.HARMLESS)):
        texts = [fill(t, rng) for t in templates[::5] for _ in range(20)]
        top, _ = scorer.top([disguise(t, rng) if label else t for t in texts])
        print("seeds left out:", "harmless" if not label else CATEGORIES[label - 1], len(texts), "above the threshold", int((top.max(axis=1) > THRESHOLD).sum() if not label else (top[:, label - 1] > THRESHOLD).sum()))


def shared_fragments(folder: str, words: int = 4) -> list[tuple[str, ...]]:
    """The runs of so many words that seeds have in common with the documents of a folder."""
    runs = lambda text: {tuple(s[i : i + words]) for s in sentences(text) for i in range(len(s) - words + 1)}
    mine = {run for templates in (S.ABUSIVE, S.HATEFUL, S.SEXUAL, S.HARMLESS) for t in templates for part in re.split(r"\{\w\}", t) for run in runs(part)}
    shared = set()
    for text in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column("text").to_pylist():
        shared |= mine & runs(text or "")
    return sorted(shared)


def main(folder: str, out: str = WEIGHTS) -> None:
    if out == "--hold-out":
        hold_out(folder)
    else:
        np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in fit(labelled(folder)[:LABELLED]).items()})


if __name__ == "__main__":
    main(*sys.argv[1:])
