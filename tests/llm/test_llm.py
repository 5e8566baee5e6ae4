"""The training-data operators against brute force, round trips, SQL and held-out figures."""

import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from thoughtloom.llm import chat_format, html_extract, imatch, language_id, masked_lm, minhash_dedup, queries, quality_rules, sentence_pieces, source_mix, suffix_dedup
from thoughtloom.llm.common import stored

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BASE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten eleven twelve"
ODD = [
    (0, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, " \n\t ", "en", "a", 4),
    (3, BASE, "en", "a", len(BASE)),
    (4, BASE, None, None, len(BASE)),
    (5, BASE + " more", "en", "b", len(BASE) + 5),
    (6, "zwei Wörter", "de", "b", 11),
    (7, "éé " * 4000 + BASE, "fr", "c", 0),
    (8, "💡", "xx", "c", 1),
    (9, "12 34 56", "en", "c", 8),
    (None, BASE, "en", "a", 1),
    (3, BASE, "en", "a", len(BASE)),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"id": F.lit(1), "k": F.lit("x"), "failed": F.lit(7), "n_words": F.lit(-1), "doc": F.lit("d"), "key": F.lit(0), "component": F.lit("c"), "size": F.lit(3)})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


EMPTY = {"documents": DOCS, "conversations": "conv_id bigint, turn bigint, role string, text string", "pages": "page_id bigint, url string, html string"}
OPS = {
    "op1": imatch.op1, "op2": suffix_dedup.op2, "op3": sentence_pieces.op3, "op4": quality_rules.op4, "op6": source_mix.op6, "op8": masked_lm.op8, "op9": minhash_dedup.op9, "op10": language_id.op10,
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_odd_rows(odd, name):
    assert OPS[name](odd).count() == len(ODD)


def _key(r):
    return (r.doc_id is None, r.doc_id)


def test_odd_values(odd):
    """Nulls, blanks, repeated rows and ids: the defined results."""
    text = {i: t for i, t, *_ in ODD}
    by = lambda name: {i: [r for r in got if r.doc_id == i] for got in [OPS[name](odd).collect()] for i in text}
    one = by("op1")
    assert one[0][0].n_chars == 0 and one[3][0].fingerprint == one[3][1].fingerprint == one[4][0].fingerprint == one[None][0].fingerprint
    two = by("op2")
    for i, found in two.items():
        for r in found:
            raw = (text[i] or "").encode()
            assert r.n_bytes == len(raw) and r.n_removed == (0 if i != 7 else r.n_removed)
    assert two[7][0].n_removed >= 4000 * 5 - 400
    three = by("op3")
    assert three[0][0].n_tokens == three[1][0].n_tokens == 1 and three[3][0] == three[3][1]
    six = by("op6")
    assert [six[i][0].size for i in (0, 1, 2, 9)] == [0, 0, 0, 3] and len(six[3]) == 2
    eight = by("op8")
    assert [(r.n_tokens, r.log_likelihood, r.mean_log_likelihood) for i in (0, 1, 2) for r in eight[i]] == [(0, 0.0, 0.0)] * 3
    assert eight[3][0].log_likelihood == eight[3][1].log_likelihood == eight[None][0].log_likelihood
    nine = by("op9")
    assert [(r.n_shingles, r.component_id, r.kept) for i in (0, 1, 2) for r in nine[i]] == [(0, 0, True), (0, 1, True), (0, 2, True)]
    assert {r.component_id for i in (3, 4, 5, None) for r in nine[i]} == {3} and sorted(r.kept for r in nine[3]) == [False, True]
    ten = by("op10")
    assert all(ten[i][0].lang_pred == "und" for i in (0, 1, 2, 8, 9))


def test_odd_conversations_and_pages(spark):
    rows_ = [(1, 1, "assistant", "b", 9), (1, 0, "user", None, 9), (1, 1, "assistant", "b", 9), (None, 0, "user", "x", 9), (2, None, None, "<|im_end|>", 9)]
    got = {r.conv_id: r for r in chat_format.op5(spark.createDataFrame(rows_, EMPTY["conversations"] + ", turns int")).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {1: 3, None: 1, 2: 1, -1: 2} and got[1].loss_chars == 2
    page = "<p>some text</p>"
    pages_ = [(1, "http://a/b", page, 1), (1, "http://a/b", page, 1), (None, None, page, 1), (2, "no url", "x" * 3_000_000, 1)]
    found = html_extract.op7(spark.createDataFrame(pages_, EMPTY["pages"] + ", host int")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in found) == [("1", 9), ("1", 9), ("2", 3_000_000), ("None", 9)]


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_table(spark, name):
    assert OPS[name](spark.createDataFrame([], DOCS)).count() == 0


def test_other_empty_tables(spark):
    assert chat_format.op5(spark.createDataFrame([], EMPTY["conversations"])).count() == 1
    assert html_extract.op7(spark.createDataFrame([], EMPTY["pages"])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, duck, name):
    assert rows(queries.queries()[name](spark, sf).toPandas()) == rows(duck.execute(queries.oracle_sql()[name]).df())


# ---- 1: I-Match


def brute_imatch(texts, least=0.0005, most=0.02):
    """Fingerprints as {(tier, slot): value} from plain sets of words; the values are compared, not their bits."""
    from thoughtloom.llm.common import U64, WordHashes, mix

    hashes = WordHashes()
    words = {i: set(t.lower().encode().translate(imatch._PLAIN).split()) for i, t in texts.items()}
    df = Counter(w for x in words.values() for w in x)
    band = {w for w, n in df.items() if n > 1 and least * len(texts) <= n <= most * len(texts)}

    def of(own):
        inside = own & band
        tier = max(0, round(np.log2(len(inside)))) if inside else 0
        out = {"all": frozenset(own)} if own else {}
        draws = {w: [int(mix(np.array([hashes[w]], U64) ^ s)[0]) >> 24 for s in imatch._SALTS] for w in inside}
        for t in (tier, tier + 1):
            for slot in range(imatch.SLOTS):
                if chosen := frozenset(w for w in inside if draws[w][slot] < 1 << 40 >> t):
                    out[t, slot] = chosen
        return tier, out

    def like(a, b):
        (s, x), (t, y) = a, b
        if a == b:
            return 1.0
        if abs(s - t) > 1:
            return 0.0
        keys = {k for z in (x, y) for k in z if k == "all" or k[0] == max(s, t)}
        return sum(x.get(k) == y.get(k) for k in keys) / len(keys) if keys else 0.0

    return lambda t: of(set(t.lower().encode().translate(imatch._PLAIN).split())), like


def test_imatch(docs, texts):
    got = {r.doc_id: r for r in imatch.op1(docs).collect()}
    ids = sorted(texts)
    of, like = brute_imatch(texts)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        a, b = texts[i], texts[j]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(a)
        assert abs(got[i].near_next - like(of(a), of(b))) < 0.02 and abs(got[i].near_edited - like(of(a), of(edited))) < 0.02
    by = {}
    for i in ids:
        assert by.setdefault(texts[i], got[i].fingerprint) == got[i].fingerprint
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.8
    lex = imatch.lexicon(docs)
    for i in ids:
        own = imatch.fingerprint(imatch.terms(texts[i], imatch.WordHashes()), lex)
        assert own.hex() == got[i].fingerprint and imatch.likeness(own, bytes.fromhex(got[i].fingerprint)) == 1


def test_band_does_not_depend_on_the_size(spark):
    small = [(i, " ".join(f"t{k}" for k in range(40) if i % (k + 2) == 0)) for i in range(400)]
    large = [(1000 * c + i, t) for c in range(3) for i, t in small]
    one, three = (imatch.lexicon(spark.createDataFrame(x, "doc_id bigint, text string"), 0.01, 0.2).tolist() for x in (small, large))
    assert one and one == three
    table = imatch.lexicon(spark.createDataFrame(small, "doc_id bigint, text string"), 0.01, 0.2, most_terms=3)
    assert sorted(np.array([r.h for r in table.collect()], np.int64).astype(np.uint64).tolist()) == one


def test_imatch_beyond_the_broadcast(docs, odd):
    """A lexicon that stays a table gives the rows of one that is broadcast."""
    for df in (docs, odd, odd.limit(0)):
        want, got = (sorted(map(tuple, imatch.op1(df, n).collect()), key=str) for n in (1 << 24, 0))
        assert got == want and len(got) == df.count()
    # the general interface; band limits under which the odd rows have a lexicon
    for df, limits in ((docs, (0.0005, 0.02)), (odd, (0.1, 0.9))):
        small, large = imatch.lexicon(df, *limits), imatch.lexicon(df, *limits, most_terms=0)
        assert len(small) and large.count() == len(small)
        one, two = (sorted(map(tuple, imatch.fingerprints(df, x).collect()), key=str) for x in (small, large))
        assert one == two
        one, two = (sorted(map(tuple, imatch.with_next(df, x).collect()), key=str) for x in (small, large))
        assert one == two


# ---- 2: suffix arrays


def brute_repeats(data, length):
    count = Counter(d[j : j + length] for d in data.values() for j in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        mark = bytearray(len(d))
        for j in range(len(d) - length + 1):
            if count[d[j : j + length]] > 1:
                mark[j : j + length] = b"\1" * length
        out[i] = mark
    return out


@pytest.mark.parametrize("length,gram,small", [(40, None, 16_000), (40, 12, 2), (64, 16, 16_000)])
def test_suffix_dedup(spark, length, gram, small):
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdeé"), r.integers(1, 6)))
    passages = [" ".join(word() for _ in range(n)) for n in (10, 14, 30, 60)]
    data = {}
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.integers(0, 25))) for _ in range(3)]
        for p in r.choice(4, r.integers(0, 3)):
            parts.insert(int(r.integers(0, 4)), passages[p][int(r.integers(0, 8)) :])
        data[i] = " ".join(parts)
    data |= {60: "ab " * 60, 61: "x" * 150, 62: data[1], 63: "", 64: None}
    df = spark.createDataFrame(list(data.items()), "doc bigint, text string")
    raw = {i: (t or "").encode() for i, t in data.items()}
    want = brute_repeats(raw, length)
    got = {x.doc: suffix_dedup.spans(x.marks, len(raw[x.doc]), length) for x in suffix_dedup.marked(df, length, gram, batches=3, small=small).collect()}
    for i, mark in want.items():
        own = bytearray(len(mark))
        for a, b in got.get(i, []):
            own[a:b] = b"\1" * (b - a)
        assert own == mark, i


def test_anchors_of_long_texts():
    data = np.random.default_rng(3).integers(97, 101, 9000).astype(np.uint8).tobytes() + b"ab" * 700 + b"x" * 900
    powers = suffix_dedup.Powers()
    for whole, parts in zip(suffix_dedup.anchors_of(data, 64, 16, powers), suffix_dedup.anchors_of(data, 64, 16, powers, part=500)):
        assert whole.tolist() == parts.tolist()


def test_op2_at_its_own_length(docs, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    got = {r.doc_id: r for r in suffix_dedup.op2(docs).collect()}
    for i, mark in brute_repeats(raw, 400).items():
        kept = bytes(x for x, m in zip(raw[i], mark) if not m)
        spans = sum(1 for j, m in enumerate(mark) if m and not (j and mark[j - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw[i]), sum(mark), spans, hashlib.sha256(kept).hexdigest())


# ---- 3: sentence pieces


def test_encoder_is_the_library():
    import sentencepiece

    path = sentence_pieces.model_path()
    lib, e = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Encoder(path, cache=5)
    odd = ["", " ", "  a  b \n<s></s>\x00é ", "▁▁x ▁ y", "日本語 テスト 🤖🤖", "a" * 3000 + " " * 100 + "b", "\t\ta\r\n b　c", "<0x41> <unk> ▁", "ab " * 500, "x​y﻿", "H́é 2² ²."]
    ids = e.encode([None, *odd])
    assert ids == [[e.end]] + lib.encode(odd, add_eos=True)
    assert e.decode(ids[1:]) == lib.decode(lib.encode(odd, add_eos=True))


def test_pieces_round_trip(docs, texts):
    import sentencepiece

    got = {r.doc_id: r for r in sentence_pieces.op3(docs).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    for i, t in texts.items():
        ids = lib.encode(t, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


# ---- 4: quality rules


def brute_quality(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    hit = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality(spark, docs, sf, odd):
    for df in (docs, odd):
        for r, t in zip(quality_rules.op4(df).collect(), [x.text for x in df.collect()]):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
            assert not (r.base_failed and r.kept)
    lab = spark.read.parquet(f"{sf}/labels.parquet").join(quality_rules.op4(docs), "doc_id").toPandas()
    assert not lab[(lab.quality == 0)].kept.any()
    good = lab[(lab.quality == 1) & ~lab.base_failed]
    assert good.kept.mean() > 0.98


def test_capitals_do_not_vanish_beside_a_letter_that_grows():
    names = dict(zip(quality_rules._NAMES, quality_rules._measure("LOUD WORDS " * 20)))
    more = dict(zip(quality_rules._NAMES, quality_rules._measure("LOUD WORDS " * 20 + "İ")))
    assert names["n_upper"] == 180 and more["n_upper"] == 181


def test_ablations(docs):
    led = quality_rules.ledger(docs)
    got = {(r.policy, r.rule): r for r in quality_rules.ablations(led).collect()}
    bits = [r.failed for r in led.collect()]
    names = [r.name for r in quality_rules.rules()]
    for (policy, rule), r in got.items():
        m, b, least = quality_rules.mask(policy), 1 << names.index(rule), quality_rules.POLICIES[policy][1]
        assert r.n_docs == len(bits) and r.n_failed == sum(bool(x & b) for x in bits)
        assert r.n_rejected == sum((x & m).bit_count() >= least for x in bits)
        assert r.n_only == sum((x & m).bit_count() >= least > (x & m & ~b).bit_count() for x in bits)


# ---- 5: chat formatting


def test_chat_layouts(spark):
    records = [
        ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q<|im_end|>"}, {"role": "assistant", "content": "a"}]}, "messages", [("system", "s"), ("user", "q<|im_end|>"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "share", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "response": "a"}, "prompt_response", [("user", "q"), ("assistant", "a")]),
        ({"completion": "a", "prompt": "q"}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "x", "output": "y"}, "instruction_input", [("user", "do\n\nx"), ("assistant", "y")]),
        ({"instruction": "do", "output": "y"}, "instruction", [("user", "do"), ("assistant", "y")]),
        ({"question": "q", "answer": None}, "question_answer", [("user", "q"), ("assistant", None)]),
        ({"turns": [{"role": "user", "text": "q"}]}, "turns", [("user", "q")]),
        ({"other": 1}, "unknown", None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(99, "{broken")], "id int, record string")
    got = {r.id: (r.mapping, r.turns and [tuple(t) for t in r.turns]) for r in chat_format.canonical_json(df, keep=("id",)).collect()}
    for i, (_, name, turns) in enumerate(records):
        assert got[i] == (name, turns)
    assert got[99] == ("unknown", None)


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\n", "<;", "<n", "a\nb<", "", "<|im_end|>", "é💡<"]
    turns = [[("user\n<", t), ("assistant", u)] for t in nasty for u in nasty]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "id int, turns array<struct<role: string, text: string>>")
    for r in chat_format.read_back(chat_format.formatted(df, ("id",)), ("id",)).collect():
        assert [tuple(t) for t in r.turns] == turns[r.id] and r.loss_text == turns[r.id][1][1]


# ---- 6: mixing


def test_mixture(docs, texts):
    got = source_mix.op6(docs).collect()
    src = {r.doc_id: r.source for r in docs.collect()}
    per, target, size = Counter(), {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.size == len(texts[r.doc_id].encode().split())
        per[src[r.doc_id]] += r.taken
        target[src[r.doc_id]], size[src[r.doc_id]] = r.target, r.source_size
    for s, t in target.items():
        assert t <= 3 * size[s] + 1e-6 and abs(per[s] - t) < 1
    free = {s: t for s, t in target.items() if t < 3 * size[s] - 1e-6}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(target))}
    assert np.ptp([t / weight[s] for s, t in free.items()]) < 1e-6
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    mixed = source_mix.copies(docs, source_mix.mix(docs)).collect()
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len((r.text or "").encode().split())
    assert words == Counter({r.doc_id: r.taken for r in got if r.taken})


# ---- 7: pages


def test_pages(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.op7(pages).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_page_structures(spark):
    menu = "<div class=m><a>Home</a> <a>News</a></div>"
    rows_ = [(i, "http://h.org/x", f"<body>{menu}<div class=body><p>Story {i} is about {i * i}<p>and goes &lt;on&gt; &eacute;</div><div class=cookie-banner>ok?</div><div class=legal>Some rights</div></body>") for i in range(8)]
    rows_ += [(90, None, None), (91, "http://h.org/", ""), (92, "x", "<p>only<script>if (a<b) '</p>'</script> <!-- c --> text <b>un<i>closed"), (93, "y", "<main><ul><li>a<li>b</ul><form>f</form><table><tr><td>1<td>2</table></main>out")]
    got = {r.page_id: r.text for r in html_extract.op7(spark.createDataFrame(rows_, "page_id bigint, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"Story {i} is about {i * i}\nand goes <on> é"
    assert got[90] == "" and got[91] == "" and got[92] == "only text unclosed" and got[93] == "a\nb\n1\n2"


def test_copies_of_a_page_do_not_empty_it(spark):
    page = lambda x: f"<body><div class=m>Home News</div><div class=post-{x}><p>Story {x} about {x * x}</div></body>"
    rows_ = [(i, "http://same.org/x", page(1)) for i in range(6)]  # copies only
    rows_ += [(10 + i, "http://half.org/x", page(2)) for i in range(8)] + [(20 + i, "http://half.org/x", page(10 + i)) for i in range(6)]
    rows_ += [(30 + i, "http://text.org/x", f"<body><!-- {i} --><p>One text</body>") for i in range(6)]  # different pages, one text
    got = {r.page_id: r.text for r in html_extract.op7(spark.createDataFrame(rows_, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows_)
    for i in range(6):
        assert got[i] == "Home News\nStory 1 about 1"
        assert got[20 + i] == f"Story {10 + i} about {(10 + i) ** 2}"
        assert got[30 + i] == "One text"
    assert {got[10 + i] for i in range(8)} == {"Story 2 about 4"}


def test_misleading_names_and_templates(spark):
    inner = "<h2 class=menu>On menus {0}</h2><div class=related-work><p>Others {0}</div><section id=comment-on-law><p>Law {0}</section>"
    rows_ = [(i, f"http://one{i}.org/x", f"<article>{inner.format(i)}<div class=comments>Reader {i}</div></article>") for i in range(2)]
    # on this host every page has a block of related posts, and one page alone a section on related work
    part = "<div class=related-posts><p>See {0}</div>"
    rows_ += [(10 + i, "http://host.org/x", f"<article><p>Story {i * i}{part.format(i)}{'<div class=related-work><p>Others</div>' if i == 1 else ''}</article>") for i in range(4)]
    rows_ += [(20 + i, "http://small.org/x", f"<body><div class=t>All rights</div><p>Text {i}</body>") for i in range(3)]  # three pages are evidence
    got = {r.page_id: r.text for r in html_extract.op7(spark.createDataFrame(rows_, "page_id bigint, url string, html string")).collect()}
    for i in range(2):
        assert got[i] == f"On menus {i}\nOthers {i}\nLaw {i}"
    assert [got[10 + i] for i in range(4)] == ["Story 0", "Story 1\nOthers", "Story 4", "Story 9"]
    assert [got[20 + i] for i in range(3)] == ["Text 0", "Text 1", "Text 2"]


def test_deep_pages(spark):
    n = 100_000
    rows_ = [(1, "http://d.org/", "<div>" * n + "deep" + "</div>" * n + "<p>after"), (2, "http://d.org/", "<b>" * n + "</i>" * n + "x"), (3, "http://d.org/", "<p>" * n + "y"), (4, "http://d.org/", "<ul><li>" * 20_000 + "z")]
    got = {r.page_id: r.text for r in html_extract.op7(spark.createDataFrame(rows_, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "deep\nafter", 2: "x", 3: "y", 4: "z"}


def test_hidden_is_an_attribute_not_a_word(spark):
    inner = ["<div class='overflow-hidden'>a</div>", "<p title='the hidden cost'>b</p>", "<p data-hidden=1 data-x=hidden>c</p>", "<p hidden>d</p>", "<p class=x hidden=until-found>e</p>", "<p aria-hidden=true>f</p>", "<p style='display: none'>g</p>", "<p title=it's>h</p> 'i'"]
    got = html_extract.op7(spark.createDataFrame([(1, "http://a.org/", f"<body class='page overflow-hidden'>{''.join(inner)}</body>")], EMPTY["pages"])).head()
    assert got.text == "a\nb\nc\nh\n'i'"


def test_names_inside_an_article_are_signs_only(spark):
    parts = "<div id=menu>On menus {0}</div><figure class=banner><figcaption>A banner {0}</figcaption></figure><section id=related>Related {0}</section><aside>Aside {0}</aside><header>Head {0}</header>"
    page = "<article><p>Story {0}</p>" + parts + "<div class=comments>Reader {0}</div><form>ask</form></article><aside>Out {0}</aside><div class=banner>out</div>"
    rows_ = [(1, "http://one.org/", page.format(1))]
    # one page of four has the parts; then all of them have the aside
    rows_ += [(10 + i, "http://rare.org/", page.format(i) if i == 0 else f"<article><p>Story {i}</p></article>") for i in range(4)]
    rows_ += [(20 + i, "http://often.org/", f"<article><p>Story {i * i}</p><aside>See {i}</aside></article>") for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.op7(spark.createDataFrame(rows_, EMPTY["pages"])).collect()}
    assert got[1] == "Story 1\nOn menus 1\nA banner 1\nRelated 1\nAside 1\nHead 1"
    assert got[10] == got[1].replace("1", "0") and got[11] == "Story 1"
    assert [got[20 + i] for i in range(4)] == ["Story 0", "Story 1", "Story 4", "Story 9"]


def test_broken_markup_is_read_once():
    import time

    n = 1_000_000
    pages = ["<a " * n, "<a '" * n + '">"', '<a x="' + "<b y='>'" * (n // 4), "<p>x</p>" + '<a t="' * n, "<" * n, "</" * n, "<!-" * n, "< a=\"" * n, "<a\u00a0=" * n + ">", "<a " + " " * n, "<a b" + "=" * n + ">t", "<p x='>" * n]
    for page in pages:
        began = time.time()
        html_extract.text_of(page, set(), set(), set())
        assert time.time() - began < 20, page[:20]
    assert html_extract.text_of("a < b <c and <p>d</p> </> e", set(), set(), set()) == "a < b d\ne"
    assert html_extract.text_of("a <p>d</p> </> e <c", set(), set(), set()) == "a\nd\ne <c"
    assert html_extract.text_of("<p x='>a</p><p>b</p>", set(), set(), set()) == "a\nb"


def test_style_tree(spark):
    """Shares and importance against entropies counted by hand."""
    from math import log

    html = ["<div class=a>same</div><div class=b>one</div>", "<div class=a>same</div><div class=b>two</div>", "<div class=a>same</div><div class=b>two</div><p>", "<div class=a>same</div>"]
    df = spark.createDataFrame([("h", i, t) for i, t in enumerate(html)], "host string, page bigint, html string")
    path = {c: next(n.path for n in html_extract.parse(html[0]).children if n.tag == "div" and n.path == html_extract.Node("div", f" class={c}", html_extract.Node("html", "", None)).path) for c in "ab"}
    got = {r.path: r for r in html_extract.style_tree(html_extract.nodes(df), prior=2.0).collect()}
    a, b = got[path["a"]], got[path["b"]]
    assert (a.pages, a.share, b.pages, b.share) == (4, 1.0, 3, 0.75)
    assert abs(a.importance - 2 / 5) < 1e-9
    evidence = -(1 / 3 * log(1 / 3) + 2 / 3 * log(2 / 3)) / log(3)
    assert abs(b.importance - (2 * evidence + 2) / 4) < 1e-9


# ---- 8: language model


def test_masked_lm(spark, docs, texts):
    model = masked_lm.train(docs, size=64, own=48, hidden=12, steps=60)
    r = np.random.default_rng(1)
    mixed = []
    for i, t in texts.items():
        w = t.split()
        if len(w) > 50:
            mixed.append((i, " ".join(r.permutation(w))))
    shuffled = {x.doc_id: x.mean_log_likelihood for x in masked_lm.score(spark.createDataFrame(mixed, "doc_id bigint, text string"), model).collect()}
    real = {x.doc_id: x for x in masked_lm.score(docs, model).collect()}
    assert all(x.n_tokens == len(texts[i].lower().encode().split()) for i, x in real.items())
    assert np.mean([real[i].mean_log_likelihood for i in shuffled]) > np.mean(list(shuffled.values()))
    # brute force, word by word, from counts of the words and the shipped tables
    count = Counter(w for t in texts.values() for w in t.lower().encode().split())
    h = {w: masked_lm.xxhash.xxh3_64_intdigest(w) for w in count}
    own = {w: k for k, w in enumerate(sorted(sorted(count, key=lambda w: (-count[w], (h[w] + 2**63) % 2**64))[:48], key=h.get), 1)}
    cls = lambda w: own.get(w) or 49 + masked_lm.xxhash.xxh3_64_intdigest(w[-3:]) % 15
    mass, rare, types = Counter(), Counter(), Counter()
    for w, n in count.items():
        mass[cls(w)] += n
        if n < 2 and w not in own:
            rare[cls(w)] += n
            types[cls(w)] += 1
    for i in sorted(texts)[::9]:
        w = texts[i].lower().encode().split()
        c, total = [0, 0, *map(cls, w), 0, 0], 0.0
        for k, x in enumerate(w, 2):
            p = sum(g * float(t[(c[k - d] * 64 + c[k + d]) * 64 + c[k]]) for d, (t, g) in enumerate(zip(model.tables, model.weights), 1))
            share = 1.0 if x in own else (count[x] if count[x] >= 2 else rare[c[k]] / types[c[k]]) / mass[c[k]]
            total += np.log(p * share)
        assert abs(real[i].log_likelihood - total) < 1e-3 * max(1, len(w)), i
    for t in model.tables:
        assert np.allclose(t.reshape(64 * 64, 64).sum(1), 1, atol=1e-4)


def test_masked_lm_grows_with_the_corpus(spark):
    few = [(i, " ".join(f"w{(i * 7 + k) % 50}tion" for k in range(40))) for i in range(20)]
    many = few + [(100 + i, " ".join(f"x{(i * 11 + k) % 900}tion" for k in range(60))) for i in range(60)]
    small, large = (masked_lm.train(spark.createDataFrame(x, "doc_id bigint, text string"), size=16, own=4, hidden=4, steps=5) for x in (few, many))
    assert len(large.lexicon) > 5 * len(small.lexicon)
    # the words of a class add up to 1, rare ones included
    for m, rows_ in ((small, few), (large, many)):
        types = sorted({w for _, t in rows_ for w in t.encode().split()})
        ids = m.lexicon.ids(types)
        per = np.bincount(m.lexicon.classes[ids], np.exp(m.lexicon.log_share[ids]), 16)
        assert np.allclose(per[np.unique(m.lexicon.classes[ids])], 1, atol=1e-4)
    # words of one class, seen unequally often, have unequal scores
    skew = few + [(200 + i, "w1tion w2tion") for i in range(300)]
    model = masked_lm.train(spark.createDataFrame(skew, "doc_id bigint, text string"), size=4, own=1, hidden=4, steps=20)
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(spark.createDataFrame([(1, "w1tion w2tion"), (2, "w31tion w40tion"), (3, "w41tion w2tion")], "doc_id bigint, text string"), model).collect()}
    assert len(set(got.values())) == 3 and got[1] > got[3] > got[2]


def test_the_window_reaches_two_words_to_each_side():
    left, right = masked_lm.neighbours(np.array([1, 2, 3, 4, 5]), np.array([3, 0, 2]), 2)
    assert left.tolist() == [0, 0, 1, 0, 0] and right.tolist() == [3, 0, 0, 0, 0]


def test_network_learns():
    n = masked_lm.Network(6, 8)
    counts = np.zeros((6, 6, 6))
    for a in range(6):
        for b in range(6):
            counts[a, b, (a + b) % 6] = 5
    losses = n.train(counts, 400)
    assert losses[-1] < 0.5 * losses[0]


# ---- 9: near-duplicates


def brute_groups(texts, n, percent):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(lower).split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,percent,block", [(3, 85, 1000), (5, 80, 1000), (3, 85, 3)])
def test_near_duplicates(spark, texts, n, percent, block):
    r = np.random.default_rng(8)
    own = dict(texts)
    base = [f"w{x}" for x in r.integers(0, 5000, 160)]
    for i in range(40):  # copies with a few edits: some are linked through others only
        w = list(base)
        for p in r.integers(0, 160, r.integers(1, 6)):
            w[p] = f"e{r.integers(0, 9999)}"
        own[1000 + i] = " ".join(w)
    own |= {2000: None, 2001: "", 2002: "one TWO", 2003: "One two", 2004: "  one  two\n"}
    df = spark.createDataFrame(list(own.items()), "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.near_duplicates(df, n, percent, block=block).collect()}
    assert got == brute_groups(own, n, percent)


def test_densified_signature_estimates_similarity():
    z = minhash_dedup.Signer(3, 160, 5)
    r = np.random.default_rng(2)
    for size in (3, 12, 500):
        near = []
        for _ in range(60):
            a = np.unique(r.integers(0, 2**62, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(size * 0.8)], r.integers(0, 2**62, size - int(size * 0.8)).astype(np.uint64)]))
            near.append((z.signature(a) == z.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(near)) < 0.08


# ---- 10: languages


def test_languages(docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.op10(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def _trigrams(text):
    """Counts of byte trigrams by slot, one at a time."""
    letters = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    padded, n = b" " + letters + b" ", {}
    for i in range(len(padded) - 2):
        three = padded[i : i + 3]
        if three != b"   ":
            slot = int.from_bytes(three, "big") * 2654435761 % 2**32 >> 21
            n[slot] = n.get(slot, 0) + 1
    length = math.sqrt(sum(n.values()))
    return {slot: math.sqrt(v) / length for slot, v in n.items()}


def test_languages_against_brute_force(docs, texts):
    """Both levels, margin by margin, from the weights of the model; these are near the minimum of their objective."""
    model = language_id.train(docs)
    assert model.families == ["germanic", "romance"] and model.langs == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    squash = lambda m: 1 / (1 + math.exp(-max(-30, min(30, 3 * m))))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        x = _trigrams(text)
        margin = lambda w: sum(w[s] * v for s, v in x.items()) + w[-1]
        e = [math.exp(max(-30, min(30, 3 * margin(w)))) for w in model.first]
        family = model.families[e.index(max(e))]
        a, b = model.langs[family]
        p = squash(margin(model.pairs[a, b]))
        assert got[i].lang_pred == (a if p >= 0.5 else b)
        assert abs(got[i].score - max(e) / sum(e) * max(p, 1 - p)) < 1e-4
    rows = language_id.sample(docs).collect()
    x = np.array([language_id.features(r.text) for r in rows])
    y = np.array([1.0 if r.lang in ("de", "en") else -1.0 for r in rows])
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    x = np.hstack([x, np.ones((len(x), 1))])
    loss = lambda w: w @ w / 40 + (share * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    w = model.first[0].astype(float)
    slope = w / 20 - 2 * x.T @ (share * np.maximum(0, 1 - y * (x @ w)) * y)
    assert np.abs(slope).max() < 0.01 and loss(w) < loss(0 * w) / 2


def test_languages_sample_is_bounded(spark):
    text = lambda i: f"some words {i} of a text"
    rows = [(i, text(i), "en") for i in range(3000)] + [(7000, text(0), "de")] * 2000 + [(i, text(i), "pt-BR") for i in range(8000, 8600)] + [(9000, "x", "zz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    n = {r.lang: r["count"] for r in language_id.sample(docs, 100, 3).groupBy("lang").count().collect()}
    assert set(n) <= {"en", "de", "pt-BR"} and 60 < n["en"] < 150 and n.get("de", 0) <= 1 and 60 < n["pt-BR"] < 150
    assert language_id.sample(docs, 1000, 4, most_rows=400).count() < 400
    assert [language_id.family_of(x) for x in ("pt-BR", "EN_us", "zz")] == ["romance", "germanic", "zz"]
    assert {r.lang_pred for r in language_id.op10(docs, 100, 1).collect()} == {"en"}


def test_languages_without_labels(spark, odd):
    got = {r.doc_id: r.lang_pred for r in language_id.op10(odd.withColumn("lang", F.lit(None).cast("string"))).collect()}
    assert set(got.values()) == {"und"}
    got = language_id.op10(odd)
    assert {r.doc_id: r.lang_pred for r in got.collect()}[9] == "und"


# ---- pipeline


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "minhash_dedup", "suffix_dedup", "source_mix", "sentence_pieces"]
    kept = docs
    for name, f in p.STAGES[:-1]:
        before = kept
        kept = stored(f(spark, kept, sf), name)
        assert kept.dtypes == docs.dtypes
        if name == "quality_rules":
            judged = {r.doc_id for r in quality_rules.op4(before).where("kept").collect()}
            assert {r.doc_id for r in kept.collect()} == judged
        if name == "minhash_dedup":
            groups = brute_groups({r.doc_id: r.text for r in before.collect()}, 5, 80)
            assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in groups.items() if i == c}
        if name == "suffix_dedup":
            raw = {r.doc_id: r.text.encode() for r in before.collect()}
            want = {}
            for i, mark in brute_repeats(raw, 256).items():
                t = bytes(x for x, m in zip(raw[i], mark) if not m).decode("utf-8", "ignore")
                if t.encode().split():
                    want[i] = t
            assert {r.doc_id: r.text for r in kept.collect()} == want
    last = p.STAGES[-1][1](spark, kept, sf)
    assert last.count() == kept.count() and set(last.columns) == {"doc_id", "source", "n_tokens", "ids", "decoded_sha256"}


def test_stages_on_odd_and_empty_tables(spark, sf):
    import corpus_pipeline as p

    def words(rows_):
        return Counter(x for r in rows_ for x in (r.text or "").encode().split())

    table = spark.createDataFrame(ODD, DOCS)
    stages = dict(p.STAGES)
    for name, f in p.STAGES:
        assert f(spark, spark.createDataFrame([], DOCS), sf).count() == 0, name
    assert stages["quality_rules"](spark, table, sf).count() == quality_rules.op4(table).where("kept").count()
    near = stages["minhash_dedup"](spark, table, sf).collect()
    # 3 (twice), 4 and null are copies, 5 and 7 have few shingles more
    assert sorted((r.doc_id for r in near), key=str) == [0, 1, 2, 3, 6, 8, 9]
    assert stages["sentence_pieces"](spark, table, sf).count() == len(ODD)
    # a long clean text as two equal rows, and another twice without an id, stay once through both stages
    long = [" ".join(f"{c}{i}" for i in range(90)) for c in "pqr"]
    two = spark.createDataFrame([(1, long[0], "en", "a", 1), (1, long[0], "en", "a", 1), (None, long[1], "en", "a", 1), (None, long[1], "en", "a", 1), (2, long[2], "en", "b", 1), (2, "one other text", "en", "b", 1)], DOCS)
    near = stored(stages["minhash_dedup"](spark, two, sf), "near")
    assert sorted((str(r.doc_id), r.text) for r in near.collect()) == sorted([("1", long[0]), ("None", long[1]), ("2", long[2]), ("2", "one other text")])
    left = stored(stages["suffix_dedup"](spark, near, sf), "left")
    assert sorted(r.text for r in left.collect()) == sorted([*long, "one other text"])
    # the mixture has exactly the words that it takes of each row, whatever the ids
    for t in (table, two):
        mixed = source_mix.mix(t).collect()
        got = stages["source_mix"](spark, t, sf).collect()
        assert sum(words(got).values()) == sum(r.taken for r in mixed)
        assert {r.doc_id for r in got} == {r.doc_id for r in mixed if r.taken}
