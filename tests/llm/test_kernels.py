"""The operators' kernels against brute force, exact round trips and held-out accuracy."""

import io
import random

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from photolake.llm import decontaminate, html, langid, licenses, lm, mjpeg, quality, simhash, sstable
from photolake.llm.common import WordHash


def brute_simhash(text):
    w = text.lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force():
    rng = random.Random(1)
    docs = [b"", b"a", b"A b", b"x" * 90 + b" y z w", b" \n "] + [b" ".join(bytes(rng.choices(b"abCdefgh", k=rng.randint(1, 14))) for _ in range(rng.randint(1, 700))) for _ in range(60)]
    assert simhash.simhash(docs).tolist() == [brute_simhash(d) for d in docs]


def components(ids, pairs):
    up = {int(x): int(x) for x in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(int(a)), root(int(b))
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.fixture(scope="module")
def fingerprints():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = []
    for p in points[:200]:
        q = int(p)
        for _ in range(5):
            for b in rng.choice(64, 2, replace=False):
                q ^= 1 << int(b)
            near.append(q)
    points = np.unique(np.concatenate([points, np.array(near, dtype=np.uint64)]))
    pairs = [(points[i], points[j]) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2) if j > i]
    return points, components(points, pairs)


def test_vantage_point_search_loses_no_link(fingerprints):
    points, want = fingerprints
    src, dst = simhash.stars(points, 2, brute=50)
    assert components(points, zip(src, dst)) == want
    nodes = simhash.build(points[::3], 12, 2)
    at, leaf = simhash.route(points, nodes, 2)
    assert len(nodes) > 5
    edges = [e for k in set(leaf.tolist()) for e in zip(*simhash.stars(points[at[leaf == k]], 2))]
    assert components(points, edges) == want


def test_links_on_spark(spark, fingerprints):
    points, want = fingerprints
    fps = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    found = simhash.links(fps, len(points), leaf_rows=100).collect()
    mask = (1 << 64) - 1
    assert components(points, [(r.src & mask, r.dst & mask) for r in found]) == want


ODD = ["", "a", " a", "a b", "a  b", "a\n b", "  x  ", "\n\n", "wörld's it's  we're\tgood \n\n end ", "x" * 400 + " y\x1cz !\x1c a", "日本語 テキスト 12 34, 5.6!?  　 z", " <|endoftext|> hi<|endoftext|>", "a\xa0b \xa0 c", " \n a\x85b   c d  ", "a \tb"]


def test_pieces_give_the_tokenizers_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), sstable.PieceEncoder(path, most=10)
    tokenizer.encode_special_tokens = True
    for _ in range(2):
        ids, starts = encoder([t.encode() for t in ODD])
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]


def test_shard_round_trip_and_lookup():
    writer, rng = sstable.ShardWriter(2), np.random.default_rng(3)
    want = {i * 3 - 50: rng.integers(0, 50_000, rng.integers(0, 4000)).astype("<u2") for i in range(200)}
    for k, v in want.items():
        writer.add(sstable.sort_key(k), v.tobytes())
    writer.add(sstable.sort_key(None), b"\2\0")
    writer.add(sstable.sort_key(None) + b"\0\0\0\1", b"\3\0")
    reader = sstable.ShardReader(io.BytesIO(writer.finish()))
    assert len(reader.index) > 5
    assert [(sstable.doc_id_of(k), v.tolist()) for k, v in reader][:-2] == [(k, v.tolist()) for k, v in want.items()]
    for k in (-50, 1, 547, 262):
        assert [v.tolist() for v in reader.get(k)] == ([want[k].tolist()] if k in want else [])
    assert [v.tolist() for v in reader.get(None)] == [[2], [3]]
    assert reader.get(2) == [] and reader.get(10**9) == []
    assert sum(reader.may_hold(sstable.sort_key(k)) for k in range(10_000, 12_000)) < 100


@pytest.fixture(scope="module")
def network():
    """A network of 1,024 words whose frequencies fall as a power."""
    c = (100_000 / np.arange(1, 1024)).astype(np.int64)
    vocabulary = lm.Vocabulary({b"": 0} | {b"w%d" % i: i for i in range(1, 1023)}, c, np.arange(1, 1024, dtype=np.int32), int(c.sum()), 1023)
    return lm.start(vocabulary)


def test_network_is_a_distribution_and_carries_its_state(network):
    assert len(network.class_of) == 1024 and len(network.edges) > 20
    h = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    p = np.exp(lm.log_likelihood(network, np.repeat(h, 1024, axis=0), np.arange(1024))[0])
    assert abs(p.sum() - 1) < 1e-4
    # scores that overflow are worked out once more
    far = lm.Network(network.edges, network.flat * 60)
    assert abs(np.exp(lm.log_likelihood(far, np.repeat(h, 1024, axis=0), np.arange(1024))[0]).sum() - 1) < 1e-3
    tokens = [np.random.default_rng(n).integers(0, 1024, n) for n in (1, 40, 7)]
    whole = lm.log_probabilities(network, np.concatenate(tokens), np.array([1, 40, 7]))
    cut = lm.log_probabilities(network, np.concatenate(tokens), np.array([1, 40, 7]), window=3)
    one = [lm.log_probabilities(network, t, np.array([len(t)]))[0] for t in tokens]
    assert np.allclose(whole, cut, rtol=1e-4) and np.allclose(whole, one, rtol=1e-4)


def test_score_of_a_text_equals_plain_recurrence(network):
    """The network written out a word at a time, in 64 bits."""
    net, H = network, lm.HIDDEN
    w = {k: getattr(net, k).astype(np.float64) for k in ("emb", "p", "b", "u", "gw", "cw", "ww")}
    rng = np.random.default_rng(4)
    for n in (1, 2, 90):
        tokens = np.append(rng.integers(2, 1024, n - 1), lm.END)
        h, x, total = np.zeros(H), lm.END, 0.0
        for y in tokens.tolist():
            a, u = w["emb"][x] @ w["p"] + w["b"], h @ w["u"]
            z, r = (1 / (1 + np.exp(-(a + u)[k * H : (k + 1) * H])) for k in (0, 1))
            new = np.tanh(a[2 * H :] + r * u[2 * H :])
            h = z * h + (1 - z) * new
            c = int(net.class_of[y])
            group = int(net.group_of[c])
            low, high = net.groups[group], net.groups[group + 1]
            first, last = net.edges[c], net.edges[c + 1]
            for scores, pick in ((w["gw"] @ np.append(h, 1), group), (w["cw"][low:high] @ np.append(h, 1), c - low), (w["ww"][first:last] @ np.append(h, 1), y - first)):
                total += scores[pick] - np.log(np.exp(scores).sum())
            x = y
        assert abs(lm.log_probabilities(net, tokens, np.array([n]))[0] - total) < 1e-4 * abs(total)


def test_network_gradient(network):
    net = lm.Network(network.edges, network.flat.astype(np.float64))
    h, y = np.random.default_rng(1).normal(size=(6, lm.HIDDEN)), np.array([1, 2, 40, 41, 1000, 3])
    g = lm.Network(net.edges, np.zeros_like(net.flat))
    back = lm.log_likelihood(net, h, y, g)[1]
    assert np.abs(g.gw).max() > 0 and np.abs(g.cw).max() > 0 and np.abs(g.ww).max() > 0
    for i in np.flatnonzero(g.flat)[:: max(1, np.count_nonzero(g.flat) // 25)]:
        step = np.zeros_like(net.flat)
        step[i] = 1e-5
        d = [-lm.log_likelihood(lm.Network(net.edges, net.flat + s * step), h, y)[0].sum() for s in (1, -1)]
        assert abs((d[0] - d[1]) / 2e-5 - g.flat[i]) < 1e-4
    e = np.zeros_like(h)
    e[2, 5] = 1e-5
    d = [-lm.log_likelihood(net, h + s * e, y)[0].sum() for s in (1, -1)]
    assert abs((d[0] - d[1]) / 2e-5 - back[2, 5]) < 1e-4


def test_gradient_through_a_window(network):
    """The recurrent part's gradients, of one window, against differences of the whole likelihood."""
    rng = np.random.default_rng(2)
    tokens = [np.append(rng.integers(2, 1024, n - 1), lm.END) for n in (5, 3, 6)]
    lengths = np.array([5, 3, 6])
    seen = {}

    class Kept(lm.Trainer):
        def _update(self, rows, of_rows, n):
            seen.update(flat=self.grad.flat.copy(), rows=rows, of_rows=of_rows)
            super()._update(rows, of_rows, n)

    few = lm.LANES
    try:
        lm.LANES = 8
        Kept(network, 0.0)([np.concatenate([t]) for t in tokens])
    finally:
        lm.LANES = few
    grad = lm.Network(network.edges, seen["flat"])
    for key in ("p", "b", "u"):
        own = getattr(grad, key)
        at = np.unravel_index(np.abs(own).argmax(), own.shape)
        d = []
        for s in (1e-2, -1e-2):
            moved = lm.Network(network.edges, network.flat.copy())
            getattr(moved, key)[at] += s
            d.append(-lm.log_probabilities(moved, np.concatenate(tokens), lengths).sum())
        assert abs((d[0] - d[1]) / 2e-2 - own[at]) < 0.02 * abs(own[at]) + 1e-3, key


def test_network_learns_a_pattern(network):
    text = np.array([5, 9, 200, 7] * 10 + [lm.END])
    before = lm.log_probabilities(network, text, np.array([len(text)]))[0]
    after = lm.log_probabilities(lm.train(network, [text] * 300, 0.1), text, np.array([len(text)]))[0]
    assert after > 0.5 * before


def test_lm_scores_beat_counts_on_held_out(spark):
    folder = "/root/testdata/sf0.001"
    found = lm.op1_lm_score(spark, folder).toPandas()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    import zlib
    from collections import Counter

    learn = Counter(w for i, t in docs.items() if zlib.crc32(str(i).encode()) % 10 for w in [*t.encode().lower().split(), b""])
    n, v = sum(learn.values()), len(learn)
    for r in found.itertuples():
        words = [*docs[r.doc_id].encode().lower().split(), b""]
        assert abs(r.base_score - sum(np.log10((learn[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)) < 1e-6
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(learn[w] > 0 for w in words), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_frames_hold_bytes_exactly():
    x = np.random.default_rng(0).integers(0, 256, (30, mjpeg.FRAME), dtype=np.uint8)
    frames = mjpeg.encode_frames(x)
    image = mjpeg.Image(frames[0])
    scans = [f[len(image.header) : -2] for f in frames]
    assert (mjpeg.cells(image, scans) == x).all()
    assert (mjpeg.pixels(image, scans).reshape(30, 24, 8, 24, 8) == x.reshape(30, 24, 1, 24, 1)).all()
    rate, back = mjpeg.indexed_frames(mjpeg.avi(frames))
    assert (rate, back) == (25.0, frames)


def test_other_coefficients_are_decoded():
    lengths = {2: [0x00, 0x11, 0x02]}
    head = b"\xff\xd8" + mjpeg._segment(0xDB, bytes([0] + [4] * 64)) + mjpeg._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + mjpeg._segment(0xC4, mjpeg._table(0, {1: [3]}) + mjpeg._table(16, lengths)) + mjpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    # DC 5; run 1 and value -1 (the second coefficient); value 3 (the third); end of block
    bits = "0" + "101" + "01" + "0" + "10" + "11" + "00"
    data = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    image = mjpeg.Image(head)
    dc, others = mjpeg.coefficients(image, [data])
    assert dc.tolist() == [[5]] and [x.tolist() for x in others[0]] == [[0, 0], [2, 3], [-1, 3]]
    u = np.zeros((8, 8))
    z = mjpeg.ZIGZAG
    u.ravel()[z[0]], u.ravel()[z[2]], u.ravel()[z[3]] = 20, -4, 12
    c = lambda k: np.sqrt(1 / 8) if k == 0 else 0.5
    want = [[sum(c(i) * c(j) * u[i, j] * np.cos((2 * y + 1) * i * np.pi / 16) * np.cos((2 * x + 1) * j * np.pi / 16) for i in range(8) for j in range(8)) + 128 for x in range(8)] for y in range(8)]
    assert (mjpeg.pixels(image, [data])[0] == np.rint(want)).all()


def test_shots_part_at_changes():
    a, b = np.full((20, mjpeg.FRAME), 40, np.uint8), np.full((15, mjpeg.FRAME), 200, np.uint8)
    assert mjpeg.shots(np.concatenate([a, b, a])) == [(0, 19), (20, 34), (35, 54)]
    assert mjpeg.shots(a) == [(0, 19)] and mjpeg.shots(a[:1]) == [(0, 0)] and mjpeg.shots(a[:0]) == []


def test_clips_of_stored_media(spark):
    docs = spark.createDataFrame([(1, "a" * 576 * 3 + "é" * 288 * 4), (2, None)], "doc_id long, text string")
    found = [tuple(r) for r in mjpeg.clips(mjpeg.store(docs)).orderBy("doc_id", "clip").collect()]
    assert found == [(1, 0, 0, 2, 0.0, 0.12), (1, 1, 3, 6, 0.12, 0.28), (2, 0, 0, 0, 0.0, 0.04)]


PAGES = [
    ("<article><h1>T</h1><p>One &amp; two&nbsp;<b>bold</b><br>three.</p><p>Four, five.</article>", "T\nOne & two bold three.\nFour, five."),
    ('<body><header>Logo</header><div class="content"><p>Long text, with commas, and more of it here.</p><p>More.</p></div><aside>side</aside><div id="comments"><p>A reader, who wrote, a very, very, long, comment, here.</p></div><footer>f</footer>', "Long text, with commas, and more of it here.\nMore."),
    ('<script>var t="<p>no</p>";</script><style>p{}</style><main><p>Yes.</p><form><p>no</p></form><div class="cookie-notice">no</div></main>', "Yes."),
    ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>a<!-- x <p>no --> b</p><noscript><p>no</p></noscript><textarea>no</textarea></article>", "a b"),
    ("<nav><a href=x>only menu</a></nav>", ""),
    ("plain text only", "plain text only"),
    ("", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html.main_text(page) == text


def edited(text, share, rng):
    out = list(text)
    for i in sorted(rng.sample(range(len(out)), int(len(out) * share)), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("abcdefgh")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, rng.choice("abcdefgh"))
    return "".join(out)


def test_edited_passages_are_found_and_others_left():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(900)]
    items = [" ".join(rng.choices(words, k=40)) for _ in range(20)]
    index, alnum = decontaminate.build_index(list(range(20)), items), decontaminate._alnum()
    docs, want = [], set()
    for i in range(60):
        text = " ".join(rng.choices(words, k=300))
        if i % 3:
            item = i % 20
            passage = edited(items[item], 0.02 * (i % 3), rng)
            text = text[:500] + " " + (passage.upper() if i % 2 else passage.replace(" ", " , ")) + " " + text[500:]
            want.add((i, item))
        docs.append(text)
    found = decontaminate.matches(docs, index, alnum)
    assert {(f[0], f[1]) for f in found} == want
    assert all(450 < f[2] < 560 for f in found)
    # hits are worked on in stretches: none is lost
    assert {(f[0], f[1]) for f in decontaminate.matches(docs, index, alnum, most_hits=400)} == want


def test_banded_edits_equal_plain_dynamic_programming():
    rng = random.Random(2)
    for _ in range(40):
        a = "".join(rng.choices("abc", k=rng.randint(5, 30)))
        b = "".join(rng.choices("abc", k=rng.randint(0, 4))) + edited(a, 0.2, rng)
        row = [0] * (len(b) + 1)
        for ch in a:
            new = [row[0] + 1]
            for j, d in enumerate(b):
                new.append(min(row[j] + (ch != d), row[j + 1] + 1, new[j] + 1))
            row = new
        got, _ = decontaminate.edits(np.array(list(map(ord, a))), np.array([-1] * 20 + list(map(ord, b))), 20, 100)
        assert got == min(row)


def test_license_scan_equals_brute_force():
    rng = random.Random(3)
    templates = {**licenses.TEMPLATES, "own": " ".join(f"t{i}x" for i in range(30))}
    catalogue, word_hash = licenses.catalogue(templates), WordHash()

    def grams(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    def plain(text):
        return ["#" if w.replace(".", "").replace("+", "").replace("-", "").isdigit() else w for w in licenses.words_of(text)]

    docs = []
    for i in range(80):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(0, 300))]
        body = list(templates.values())[i % len(templates)].split()
        if i % 3 == 0:
            body = body[: max(5, int(len(body) * 0.93))]
        if i % 4:
            words[len(words) // 2 : len(words) // 2] = body
        docs.append(" ".join(words))
    want = {(i, name) for i, d in enumerate(docs) for name, t in templates.items() if len(grams(plain(t)) & grams(plain(d))) >= 0.8 * len(grams(plain(t)))}
    found = licenses.scan(docs, catalogue, word_hash)
    assert {(f[0], catalogue.names[f[1]]) for f in found} == want
    assert len(want) > 40


def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = quality.op3_quality(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert (found.predicted == found.quality).mean() > 0.9
    assert found[found.quality == 1].predicted.mean() > 0.97


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = langid.op5_language_id(spark, folder).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert found > 0.99
