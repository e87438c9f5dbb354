"""Each operator against brute force on small fixtures, and on awkward input."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import decontaminate, html, licenses, lm_score, neardup, packing, pii, quality, sharding, tokens
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def noise(n, alphabet, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(n)]


# 1 ---------------------------------------------------------------------------------------------

def test_quality_base_counts(spark, texts):
    got = rows_of(QUERIES["op1_quality_rules"](spark, SF))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {j for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_kneser_ney_matches_its_definition():
    words = [b"banana", b"bandana", b"cab", b"abc"]
    code, _ = quality.grams_of(words, quality._alphabet())
    keys, n = np.unique(code, return_counts=True)
    model = quality.KneserNey(keys, n)
    contexts = defaultdict(list)
    for k in keys:
        contexts[int(k) >> 6].append(int(k))
    for c in contexts:  # probabilities of all symbols after a seen context add up to one
        whole = np.arange(64) + (c << 6)
        assert math.isclose(model._prob(whole.astype(np.int64)).sum(), 1.0, rel_tol=1e-9)
    # by hand: P(a | ban) = (c - D)/c(ban) + gamma * P(a | an)
    alphabet = quality._alphabet()
    gram = 0
    for ch in "bana":
        gram = gram << 6 | int(alphabet[ord(ch)])
    d = quality.KneserNey._discounts(n)
    follow = {k: int(m) for k, m in zip(keys, n) if int(k) >> 6 == gram >> 6}
    total = sum(follow.values())
    gamma = sum(d[min(m, 3)] for m in follow.values()) / total
    want = (follow[gram] - d[min(follow[gram], 3)]) / total + gamma * model._prob(np.array([gram & (64 ** 3 - 1)]), 3)[0]
    assert math.isclose(model._prob(np.array([gram]))[0], want, rel_tol=1e-12)


def test_quality_rejects_noise_and_keeps_sound_text(spark):
    rng = random.Random(1)
    vocabulary = ["the", "river", "runs", "under", "stone", "bridge", "water", "slowly", "toward", "evening", "village", "market"]
    sound = [(i, " ".join(rng.choices(vocabulary, k=80)), "en") for i in range(200)]
    odd = [(900, " ".join("".join(rng.choices("qxzjkvw", k=7)) for _ in range(80)), "en")]
    copies = [(1000 + i, sound[0][1], "en") for i in range(150)]
    got = rows_of(quality.quality_rules(spark.createDataFrame(sound + odd + copies, "doc_id long, text string, lang string")))
    assert not got[900].kept
    assert all(got[i].kept or got[i].base_failed for i in range(200))


def test_languages_in_several_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"wort{i} abc def " * 20, f"l{i % 4}") for i in range(20)] + [(99, "", "zz")],
                                 "doc_id long, text string, lang string")
    one = {r.doc_id: r.log10_prob for r in quality.score_quality(docs).collect()}
    monkeypatch.setattr(quality, "MODEL_ENTRIES", 10)
    many = {r.doc_id: r.log10_prob for r in quality.score_quality(docs).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k]) for k in one)


def test_model_spells_every_character(spark):
    """No two characters count as one, and the grams are those of the spelled words."""
    alphabet = quality._alphabet()
    points = np.delete(np.arange(0x110000), 10)
    assert len(np.unique(alphabet[points])) == len(points) and alphabet[points].all()

    def spelled(text):
        for word in text.split():
            out = [0, 0, 0]
            for ch in word:
                code, own = int(alphabet[ord(ch)]), []
                while code:
                    code, own = code >> 6, [code & 63, *own]
                out += own
            out.append(0)
            yield from (out[i - 3] << 18 | out[i - 2] << 12 | out[i - 1] << 6 | out[i] for i in range(3, len(out)))

    texts = ["Tag 1 für 7 世界", "tag 1 für 7 世界", "Tag 1 fér 7 世界", "Tag 2 für 7 世界", "Tag 1 für 7 世畀", "Nag 1 für 7 世界",
             "", "b", "b c", "😀 # ﷽ \U0010ffff x\x01 \x00"]
    counts = Counter(g for t in texts for g in spelled(t))
    model = quality.KneserNey(np.array(list(counts)), np.array(list(counts.values())))
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: r.log10_prob for r in quality.score_quality(docs).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i], model.log10(np.array(list(spelled(t)), np.int64)).sum(), rel_tol=1e-9, abs_tol=1e-12), t


# 2 ---------------------------------------------------------------------------------------------

def test_licenses_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [("LICENSE", f"{apache}\n"), ("a/LICENSE.txt", f"text\n{mit}"), ("a/b/code.c", "int main"), ("a/b/own.c", f"x\n{apache}\ny"),
             ("c/d/e.c", "plain"), ("top.c", None), (None, "nothing"), ("a/x.c", ""), ("ab/y.c", "licensed premises on a street far away")]
    got = {r.path: (r.own_license, r.license, r.from_dir, r.origin)
           for r in licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        "LICENSE": ("Apache-2.0", "Apache-2.0", None, "own"), "a/LICENSE.txt": ("MIT", "MIT", None, "own"),
        "a/b/code.c": (None, "MIT", "a", "inherited"), "a/b/own.c": ("Apache-2.0", "Apache-2.0", None, "own"),
        "c/d/e.c": (None, "Apache-2.0", "", "inherited"), "top.c": (None, "Apache-2.0", "", "inherited"),
        None: (None, None, None, None), "a/x.c": (None, "MIT", "a", "inherited"), "ab/y.c": (None, "Apache-2.0", "", "inherited")}


def test_license_cosine_by_brute_force(spark, texts):
    idf, other, rows = licenses.template_vectors()
    templates = defaultdict(dict)
    for name, i, t, w in rows:
        templates[name, i][t] = w
    got = rows_of(QUERIES["op2_license_scan"](spark, SF))
    for i, text in texts.items():
        best = []
        for line in text.split("\n"):
            if re.search(licenses.CUE, line):
                bag = licenses.terms_of(line)
                v = {t: n * idf.get(t, other) for t, n in bag.items()}
                norm = math.sqrt(sum(x * x for x in v.values()))
                score, name = max((round(sum(v.get(t, 0) * w for t, w in vec.items()) / norm, 9), k[0]) for k, vec in templates.items())
                if score >= licenses.THRESHOLD:
                    best.append((score, name))
        r = got[i]
        assert (r.n_statements, r.own_license) == (len(best), max(best)[1] if best else None)


# 3 ---------------------------------------------------------------------------------------------

def test_shards_are_even_and_gapless(spark, texts):
    got = QUERIES["op3_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(len(t.encode()) + 1 for t in texts.values())


def test_equal_rows_are_spread(spark):
    rows = [(1, "the same row") if i % 5 else (i, f"text number {i}") for i in range(25_000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and len(size) == 8
    assert max(size.values()) - min(size.values()) <= 0.01 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_splitters_by_brute_force(spark):
    """Every boundary is as near its share of the bytes as a cut between keys can be, or within the tolerance."""
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([0, 5, 80, 3000])) for i in range(900)]
    sizes = sharding.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "text").select("__g", "__t", "__size").collect()
    ordered = sorted(map(tuple, sizes))
    total = sum(n for _, _, n in ordered)
    ends = list(itertools.accumulate(n for _, _, n in ordered))
    cuts = sharding.splitters(spark.createDataFrame([tuple(r) for r in sizes], "__g long, __t long, __size long"), 8)
    for s, cut in enumerate(cuts, 1):
        below = sum(n for g, t, n in ordered if (g, t) < cut)
        best = min(abs(e - total * s / 8) for e in [0, *ends])
        assert abs(below - total * s / 8) <= max(best, 0.001 * total / 8)


def test_hot_group_is_split_only_by_boundaries(spark):
    rows = [(i, "the same text for all" if i % 3 == 0 else f"text number {i}") for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, where = Counter(), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        where[r.text].add(r.shard)
    assert max(size.values()) <= 1.01 * sum(size.values()) / 8
    assert sum(len(s) > 1 for s in where.values()) <= 7


# 4 ---------------------------------------------------------------------------------------------

def test_unit_encoder_equals_the_tokenizer(texts):
    encoder = packing.UnitEncoder(BYTE_BPE)
    pool = list("ab \n\t.'1é世😀\x00 　\x1c") + ["the", " the", "<|endoftext|>", "'s", "don't", "12", "\r\n"]
    for t in [*noise(6000, pool), *texts.values()]:
        assert encoder.encode(t) == encoder.whole(t), repr(t)


def test_packing_of_texts(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    got = QUERIES["op4_packing"](spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.asarray([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *itertools.accumulate(r.length for r in s)][:-1]
        padding += 1024 - sum(r.length for r in s)
    assert 0 <= padding < 1024 * 9  # at most a sequence a task


def test_many_short_texts_fill_their_sequences(spark):
    df = spark.createDataFrame([(i, "five short words are here") for i in range(6000)], "doc_id long, text string").coalesce(1)
    got = packing.pack_texts(df, BYTE_BPE).collect()
    assert len({r.sequence_id for r in got}) <= sum(r.length for r in got) / 1024 + 4  # one open end a block of 2048


@pytest.mark.parametrize("segments, loss", [(None, None), (3, None), (None, 40), (4, 50)])
def test_packed_texts_have_their_ids_within_every_limit(spark, segments, loss):
    """Each piece comes with its ids; its first token has none before it, so it bears no loss."""
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices(["the", "river", "runs", "é世"], k=rng.randint(0, 90))) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = packing.pack_texts(df, BYTE_BPE, 64, segments, max_loss=loss).collect()
    encoder = packing.UnitEncoder(BYTE_BPE)
    for i, t in texts.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == encoder.whole(t) + bytes(4)
        assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in own)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r.length)
    for s in sequences.values():
        assert sum(s) <= 64 and len(s) <= (segments or 64) and sum(s) - len(s) <= (loss or 64)
    least = max(sum(map(sum, sequences.values())) / 64, len(got) / (segments or 64) if loss is None else 0)
    assert len(sequences) <= (1.3 * least + 2 if loss is None else len(got))


def test_vector_packing_respects_every_limit():
    rng = np.random.default_rng(0)
    demands = np.c_[rng.integers(1, 900, 500), rng.integers(1, 9, 500), rng.integers(0, 500, 500)].astype(float)
    demands[7] = (3000, 1, 1)
    limits = np.array([1024, 16, 512], float)
    bins = packing.pack_block(demands, limits)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert [7] in bins
    assert all((demands[b].sum(axis=0) <= limits).all() for b in bins if b != [7])
    least = (demands[demands[:, 0] <= 1024].sum(axis=0) / limits).max()
    assert len(bins) <= 1.15 * least + 2


def test_pack_examples_on_conversations(spark):
    rows = [(i, 50 + i * 37 % 700, 1 + i % 4, i * 13 % 300, "x") for i in range(300)] + [(300, None, None, None, None), (301, 5000, 1, 1, "y")]
    df = spark.createDataFrame(rows, "conv_id long, n_tokens long, n_segments long, n_loss long, offset string")
    got = packing.pack_examples(df, 1024, 8, 512).collect()
    assert sorted(r.conv_id for r in got) == list(range(302))
    for key, group in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.segment)), key=lambda r: r.sequence_id):
        group = list(group)
        if not group[0].over_limit:
            assert sum(r.n_tokens or 0 for r in group) <= 1024 and sum(r.n_segments or 1 for r in group) <= 8
        assert group[0].offset == 0


# 5 ---------------------------------------------------------------------------------------------

def test_main_text_of_pages():
    page = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home page of all</a></ul></nav>"
            "<div class='cookie-notice'>We use cookies on this site, please accept them all now.</div><div class=\"ad\">Buy <b>now</b></div>"
            "<article><h1>Head&eacute;</h1><p>One   two\n<b>thr</b>ee &lt;x&gt;<p>Short.<aside>see also</aside><script>var a='</p>';</script>"
            "<form><input name=q>find</form><p>End &amp</article><div id=comments><p>A long reader comment that is not the article at all.</p></div>"
            "<footer>&copy; all of us and everyone else as well</footer></body></html>")
    assert html.main_text(page) == "Headé\nOne two three <x>\nShort.\nEnd &"
    assert html.main_text("") == "" and html.main_text("<nav>x</nav>") == ""
    plain = ("<body><div>menu one</div>" + "<div class=sidebar>links and more links</div>" + "<p>" + "long text here " * 10 + "</p><p>more of it</p>"
             + "<div class=footer>foot</div><div>tiny</div>")
    assert html.main_text(plain) == "long text here " * 9 + "long text here\nmore of it"
    assert html.main_text("<p>only text") == "only text"
    assert html.main_text("<article><p>cut in a tag <a hre") == "cut in a tag"


def test_pages_that_mark_little_or_end_nothing():
    text, more = "a sentence of the main text " * 6, "another sentence of it " * 6
    for start in ("<html><head><title>t</title><body>", "<html><head><title>t<body>", "<html><head><meta charset=x>", "<svg><path>", "<div><svg><path></div>",
                  "<noscript><img></noscript>", "<div><template><p>no</div>"):
        for element in ("article", "main"):
            want = "" if start == "<svg><path>" else text.strip()
            assert html.main_text(f"{start}<{element}><p>{text}") == want, start
    teaser = f"<div><p>{text * 4}</p><p>{more * 4}</p></div><article><p>Read our other story on this page now.</p></article>"
    assert html.main_text(teaser) == (text * 4).strip() + "\n" + (more * 4).strip()
    assert html.main_text(f"<article><p>{text}</p></article><div>{more[:90]}</div>") == text.strip()
    named = f"<article><div class='share-of-market'>{text}</div><p class=comment>{more}</p><div class='share-buttons'>tell all</div><p class=ad>x</p></article>"
    assert html.main_text(named) == f"{text.strip()}\n{more.strip()}\nx"
    between = f"<body><p>{text}</p><aside>see also</aside><p>Short but article.</p><div class='ad-slot left'>buy</div><p>{more}</p><nav>on</nav><p>tiny</p>"
    assert html.main_text(between) == f"{text.strip()}\nShort but article.\n{more.strip()}"
    assert not html.hinted("class='download header-less adsorption'") and html.hinted("id=site-footer") and html.hinted('class="x cookie_notice-2"')


def test_surges_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randint(0, 30))]
        window = rng.randint(1, 4)
        sums = [sum(lengths[i:i + window]) for i in range(len(lengths))]
        want, i = [], 0
        while i < len(lengths):
            if lengths[i]:  # up to the next window without text
                end = next((j for j in range(i, len(lengths)) if sums[j] == 0), len(lengths))
                want.append((i, end, max(sums[i:end])))
                i = end
            else:
                i += 1
        assert html.surges(lengths, window) == want


def test_articles_are_found_without_their_element(spark):
    """The window sums alone find the article of every page: its element is taken out of the mark-up."""
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert html.main_text(re.sub(r"</?article>", "", p.html)) == html.main_text(p.html)


def test_pages_query_against_the_article_element(spark):
    import html as entities

    got = rows_of(QUERIES["op5_html_text"](spark, SF), "page_id")
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", m[1])] if m else []
        want = "\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


# 6 ---------------------------------------------------------------------------------------------

def true_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[.,;:!?]", "", lower(t or "")))
        n = min(5, len(w))
        sets[i] = Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if n else Counter()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        na, nb = sets[a].total(), sets[b].total()
        if texts[a] == texts[b] or (na and nb and min(na, nb) >= 0.8 * max(na, nb)
                                    and (c := (sets[a] & sets[b]).total()) >= 0.8 * (na + nb - c)):
            parent[find(a)] = find(b)
    out = defaultdict(set)
    for i in texts:
        out[find(i)].add(i)
    return {frozenset(x) for x in out.values()}


def test_near_duplicates_by_brute_force(spark, texts):
    got = defaultdict(set)
    for r in QUERIES["op6_near_duplicates"](spark, SF).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == true_classes(texts)
    assert all(k == min(v) for k, v in got.items())


def test_star_of_near_copies_around_one_text(spark):
    """Copies that are each near the original but not near one another are still one class."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = {0: " ".join(base)}
    for i in range(1, 60):
        w = list(base)
        for at in rng.sample(range(5, 195, 8), 4):
            w[at] = f"x{i}_{at}"
        texts[i] = " ".join(w)
    texts |= {100 + i: " ".join(f"v{rng.randrange(5000)}" for _ in range(120)) for i in range(20)}
    texts |= {200 + i: texts[0] for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(set)
    for r in neardup.near_duplicates(df).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == true_classes(texts)


def test_family_of_variants_without_its_centre(spark, monkeypatch):
    """Followers that are near one another but not near the leader of their bucket are found."""
    rng = random.Random(5)
    texts = {}
    for family in range(3):
        base = [f"f{family}w{rng.randrange(5000)}" for _ in range(200)]
        for arm in range(6):  # each arm is a chain away from the centre, whose text is not there
            w = list(base)
            for step in range(5):
                for k in range(2):
                    w[5 + 30 * arm + 6 * step + 3 * k] = f"x{arm}_{step}_{k}"
                if step > 1:
                    texts[1000 * family + 10 * arm + step] = " ".join(w)
    # One bucket for all texts: whatever is near must come out, whoever leads.
    monkeypatch.setattr(neardup, "band_keys", lambda s, bands, rows: np.zeros((len(s), bands), np.uint64))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(set)
    for r in neardup.near_duplicates(df).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == true_classes(texts)
    assert 3 < len(got) < len(texts)


def test_pairs_grow_with_the_members_of_a_family(spark, monkeypatch):
    """Variants of one text that are mostly below the threshold: pairs a member stay bounded."""
    compared = neardup._compared
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]

    def variant(i):
        w = list(base)
        for at in rng.sample(range(200), 7):
            w[at] = f"x{i}_{at}"
        return " ".join(w)

    counts = []
    for n in (150, 300, 600):
        seen = []
        monkeypatch.setattr(neardup, "_compared", lambda pairs, *rest: seen.append(pairs.count()) or compared(pairs, *rest))
        df = spark.createDataFrame([(i, variant(i)) for i in range(n)], "doc_id long, text string")
        assert neardup.near_duplicates(df).count() == n
        counts.append(sum(seen))
    assert counts[-1] <= 2.2 ** 2 * counts[0] and all(c <= 40 * n for c, n in zip(counts, (150, 300, 600))), counts


def test_links_to_any_member_of_a_large_class(spark, monkeypatch):
    """A text near one member of its bucket's largest class alone, whichever that is, belongs to the class."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = {0: " ".join(base)}
    for i in range(1, 60):  # near the first text, not near one another
        w = list(base)
        for at in (5, 45, 85, 125):
            w[at + i % 20] = f"x{i}_{at}"
        texts[i] = " ".join(w)
        if i % 10 == 0:  # one step farther than the member it comes from
            for at in (165, 172):
                w[at] = f"y{i}_{at}"
            texts[100 + i] = " ".join(w)
    monkeypatch.setattr(neardup, "band_keys", lambda s, bands, rows: np.zeros((len(s), bands), np.uint64))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = neardup.near_duplicates(df).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.class_id].add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == true_classes(texts)
    assert len(got) == 1 and len(rows) == len(texts)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8):
        error = []
        for _ in range(20):
            n = 300
            c = int(round(2 * n * share / (1 + share)))
            a, x, y = (rng.integers(1, 2**63, k).astype(np.uint64) for k in (c, n - c, n - c))
            w = rng.integers(1, 6, c) / 2
            sets = [(np.r_[a, x], np.r_[w, np.ones(n - c)]), (np.r_[a, y], np.r_[w, np.ones(n - c)])]
            s = neardup.sketch(sets, 120)
            assert (s != 0).all()
            error.append((s[0] == s[1]).mean() - w.sum() / (w.sum() + 2 * (n - c)))
        assert abs(np.mean(error)) < 0.035


# 7 ---------------------------------------------------------------------------------------------

def brute_hits(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        v = word.findall(lower(t or ""))
        n = min(window, len(v))
        windows = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k:k + n]) in windows:
                found.add(item)
                hit.update(range(k, k + n))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


@pytest.mark.parametrize("words", [500_000, 40])
def test_decontamination_by_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", words)
    rng = random.Random(5)
    pool = [f"{c}{d}" for c in "abcd" for d in "é12"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([0, 1, 2, 5, 9, 10, 11, 30])))) for i in range(25)] + [(30, None)]
    docs = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(pool, k=rng.randint(0, 80)))) for i in range(80)]
    docs += [(100 + i, f"intro {t.upper() if t else ''}! outro") for i, t in items] + [(200, None), (201, "")]
    got = rows_of(decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                                   spark.createDataFrame(items, "item_id long, text string")))
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(t, items)
        assert r.contaminated == (r.n_hit > 0)


def test_contaminated_spans_are_cut(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    clean = "this text has no passage of any test in it, " * 4
    docs = [(1, f"{clean}{item.lower()}. And more words here to follow it now", "k"), (2, clean, None), (3, item, "z"), (4, None, "n")]
    got = rows_of(decontaminate.remove_contamination(
        spark.createDataFrame(docs, "doc_id long, text string, n_removed_words string"),
        spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert got.keys() == {1, 2, 4}
    assert got[1].text == f"{clean}. And more words here to follow it now" and got[1].n_removed_words == 12
    assert got[2].text == clean and got[4].text is None


# 8 ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("head", [1 << 19, 50])
def test_lm_scores_against_exact_counts(spark, texts, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    got = rows_of(lm_score.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), filter_bits=1 << 24))
    counts = Counter()
    split = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    for i, w in split.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    total, distinct = counts.total(), len(counts)
    for i, w in split.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("lowest", [(1, 2), (2, 2), (4, 3), (lm_score.LEVELS, lm_score.LEVELS)])
def test_lm_scores_count_what_the_filter_has_no_room_for(spark, texts, monkeypatch, lowest):
    """Every word and pair counts by its own level, however few levels fit."""
    monkeypatch.setattr(lm_score, "lowest_levels", lambda *_: lowest)
    got = rows_of(lm_score.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), filter_bits=1 << 24))
    split = {i: [None, *WORD.findall(lower(t)), None] for i, t in texts.items()}
    words, pairs = Counter(), Counter()
    for i, w in split.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words.update(w[1:])
            pairs.update(zip(w, w[1:]))
    space, means = words.total() + len(words) + 1.0, lm_score.count_of_level()
    quantised = [{k: means[lm_score.level_of(np.array([float(n)]))[0]] for k, n in c.items()} for c in (words, pairs)]

    def log_p(a, b):
        ca, cb = quantised[0].get(a, 0.0), quantised[0].get(b, 0.0)
        both = min(ca, cb, quantised[1].get((a, b), 0.0))
        return math.log10((both + lm_score.STRENGTH * (cb + 1) / space) / (ca + lm_score.STRENGTH))

    for i, w in split.items():
        assert math.isclose(got[i].score, sum(map(log_p, w, w[1:])), rel_tol=1e-6), i


def test_filter_gives_quantised_counts_back():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2)
    counts = rng.geometric(0.05, 20_000)
    bits = np.zeros(1 << 21, bool)
    for h, q in ((hashes, lm_score.level_of(counts.astype(float))),):
        for level in range(1, q.max() + 1):
            for probe in range(lm_score.PROBES):
                bits[lm_score.places(h[q >= level], level, probe, 1 << 21).astype(np.int64)] = True
    held = lm_score.FrequencyFilter(np.packbits(bits, bitorder="little"), 1, (1, 1), 0, 0)
    got = held.count(hashes, 1)
    want = lm_score.count_of_level()[lm_score.level_of(counts.astype(float))]
    assert (got >= want).all() and (got == want).mean() > 0.9
    absent = held.count(rng.integers(0, 2**62, 20_000).astype(np.uint64) * np.uint64(4) + np.uint64(1), 1)
    assert (absent > 0).mean() < 0.1


# 9 ---------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    def sound(kind, v):
        digits = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if sound(k, m[0])]


def check_base(spark, docs):
    got = pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in docs)
    by = dict(docs)
    for r in got:
        want = base_spans(by[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE], by[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), by[r.doc_id]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_base_spans_on_noise(spark):
    pool = ["a", "@", ".", "b.c", "1", "23", "255", "256", ".", "-", " ", "+", "(", ")", "_", "é😀", "4111111111111111", "10.0.0.1", "x@y.z"]
    check_base(spark, [(i, t) for i, t in enumerate(noise(3000, pool, 2))])


def test_base_spans_on_documents_and_long_runs(spark, texts):
    long = {9001: "1" * 50_000, 9002: "a" * 50_000, 9003: "1 " * 30_000, 9004: "a@b." * 20_000, 9005: "1." * 30_000, 9006: None}
    check_base(spark, list((texts | long).items()))


def test_bootstrapping_finds_unseen_identifiers(spark):
    docs = [(i, f"some words then Telefon: +1 (555) 010-{1000 + i} and more text") for i in range(6)]
    docs += [(100 + i, "a copy: the year was +1 (555) 010-7777 or so") for i in range(5)]
    docs += [(200, "please ring Telefon: 0221-4711-88 today"), (201, "in the year 19871 was nothing"), (202, "was 2001234 too")]
    docs += [(203, "and again 0221-4711-88 without its context")]
    got = rows_of(pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got[200].spans == "phone:21:33" and got[203].spans == "phone:10:22"
    assert got[201].spans == "" and got[202].spans == ""
    redacted = rows_of(pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string"), redact=True))
    assert redacted[200].text == "please ring Telefon: [PHONE] today" and redacted[201].text == docs[-3][1]


def test_rounds_go_on_until_nothing_is_new(spark):
    """Each level of identifiers is learnt from patterns that only the level before makes trustworthy."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    level, texts = [f"seed{x}@mail.example" for x in letters[:12]], []
    for i in range(10):
        fresh = [f"{letters[i]}{letters[j]}-12345" for j in range(12)]
        for k in range(4):
            texts += [f"key{letters[i]}{letters[k]} {x}" for x in level + fresh[3 * k:3 * k + 3]]
        level = fresh
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.spans for r in got)


# 10 --------------------------------------------------------------------------------------------

def test_token_counts_equal_the_library(texts):
    counter = tokens.PieceCounter(PIECES)
    assert counter.separable and len(counter.whole) > 10_000
    pool = list("ab \n\t▁<s>é世😀.'1\x00") + ["the", " the", " </s>", "　", "   "]
    for t in [*noise(6000, pool), *texts.values()]:
        assert counter.count(t) == len(counter.encoder.encode(t)), repr(t)


def test_token_count_query(spark, texts):
    got = rows_of(QUERIES["op10_token_counts"](spark, SF))
    encoder = tokens.PieceCounter(PIECES).encoder
    for i, t in texts.items():
        n = len(encoder.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 4096)


# All -------------------------------------------------------------------------------------------

OPERATORS = {
    "quality": quality.quality_rules, "licenses": lambda d: licenses.scan_licenses(d.withColumnRenamed("source", "path")),
    "sharding": sharding.shard_documents, "packing": lambda d: packing.pack_texts(d, BYTE_BPE),
    "examples": lambda d: packing.pack_examples(d.withColumnsRenamed({"n_chars": "n_tokens"}).withColumn("n_segments", d.doc_id).withColumn("n_loss", d.doc_id)),
    "html": lambda d: html.extract_text(d, "doc_id", "source", "text"), "neardup": neardup.near_duplicates,
    "leaks": lambda d: decontaminate.find_contamination(d, d.sparkSession.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")),
    "cut": lambda d: decontaminate.remove_contamination(d, d.sparkSession.createDataFrame([(1, "absent words"), (2, None)], "item_id long, text string")),
    "lm": lambda d: lm_score.score_documents(d, filter_bits=1 << 20), "pii": pii.find_personal_data,
    "redacted": lambda d: pii.find_personal_data(d, redact=True), "tokens": lambda d: tokens.count_tokens(d, PIECES)}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_are_all_kept(awkward, name):
    df = OPERATORS[name](awkward)
    got = df.collect()
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    rows = len(got) if name != "packing" else len({(r.doc_id, r.start) for r in got if r.start == 0}) + 1
    assert rows == awkward.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(awkward, name):
    assert OPERATORS[name](awkward.where("doc_id < -1")).collect() == []
