import hashlib

import numpy as np
import pyarrow as pa

from softlattice.llm import decontaminate, secrets, sstable, urls


def leaks(item, *docs):
    index = decontaminate.build_index([(1, item)])
    t = decontaminate.tokens(pa.array(docs))
    return [bool(decontaminate.judge(index, t.template[x:y], t.plain[x:y], t.kind[x:y], 0.6, 13)) for x, y in zip(t.doc[:-1], t.doc[1:])]


def test_items_of_few_words_or_capitals_are_found():
    assert leaks("What is 2+2?", "They ask: what is 2+2? Four.", "What is 3+3?", "is 2+2?", "") == [True, False, False, False]
    gas = "WHICH GAS DO PLANTS TAKE IN FROM THE AIR"
    assert leaks(gas, f"x {gas} y", gas.lower(), gas.title(), "SOME OTHER TEXT IN CAPITALS THAT SAYS NOTHING OF ANY GAS AT ALL") == [True, True, True, False]
    train = "A train leaves the old station at 40 km every hour and reaches the coast after 3 hours of rain"
    assert leaks(train, train.upper(), train.upper().replace("40", "75").replace(" 3 ", " 9 "), train.title()) == [True, True, True]


def test_names_that_begin_a_sentence_are_slots():
    apples = "Maria has 12 apples. Maria eats 3 apples. Maria buys 9 apples. How many apples does Maria have now?"
    assert leaks(apples, apples.replace("Maria", "Anna").replace("12", "31").replace(" 3 ", " 8 "), "Anna has 4 dogs. Bob eats 3 pears. Lea buys 2 cups. How many dogs bark?") == [True, False]
    short = "Maria has 12 apples. Maria eats 3 apples. Maria buys 9 apples."
    assert leaks(short, short.replace("Maria", "Anna").replace("12", "31")) == [True]


def secret(text):
    return [text[a:b] for a, b, k in secrets.find(text) if k == "guess"]


def test_a_credential_word_as_value_hides_nothing():
    for text in ("the login password is {}", "login passphrase is {}", "secret passphrase = {}", "login credentials: {}"):
        assert secret(text.format("qX7#pL9!vR2z")) == ["qX7#pL9!vR2z"]


def test_guesses_decide_after_an_explicit_separator():
    for text in ("pwd: kZqTrxWmPvLsJbNd", "passphrase: vexil-quorn-tabzik-flom", "pwd is kZqTrxWmPvLsJbNd", "Authorization: Bearer kZqTrxWmPvLsJbNd"):
        assert secret(text) == [text.split(" ")[-1]]
    assert secret("login instructions for everybody") == [] and secret("pwd: password") == []


def test_values_of_any_length():
    jwt = "".join(hashlib.sha256(str(i).encode()).hexdigest().upper() for i in range(7))[:440]
    assert secret(f"Authorization: Bearer {jwt} end") == [jwt]
    assert secret("pwd is q#7Z!k and") == ["q#7Z!k"] and secret("pwd is abc") == [] and secret("pwd is ?") == []
    assert secret("pwd: " + "a" * 3000) == [] and secret("pwd: " + "ab1" * 2000 + " login password is qX7#pL9!vR2z") == ["qX7#pL9!vR2z"]


def test_markers_are_the_plain_library_call():
    from tokenizers import Tokenizer

    path = sstable.default_tokenizer()
    plain, mark = Tokenizer.from_file(path), "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark} b", f"a  {mark}  b", f"one.{mark}two, {mark}. {mark}{mark}", f"x{mark}3.5!{mark}'s", f"\n{mark}\n a {mark}", f"<|endof text|> {mark.upper()} |>{mark}"]
    assert plain.encode(texts[0], add_special_tokens=False).ids.count(50256) == 1
    same_ids(plain, sstable.Encoder(path), texts)


def same_ids(plain, encoder, texts):
    ids, at = encoder(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2], t


def test_ids_of_any_text_are_the_plain_library_call():
    from tokenizers import Tokenizer

    path, rng = sstable.default_tokenizer(), np.random.default_rng(5)
    plain, encoder = Tokenizer.from_file(path), sstable.Encoder(path, remember=300)
    parts = [" ", "  ", "\n", "\t", "a", "b", "Word", "\u00e9", "\u00a0", "\u3000", "\u2003", "\x85", "\u65e5\u672c", "\u0441\u043a", "\u044a", "\u0440", ".", ",", "!", "'s", "'", "3", "3.5", "<|endoftext|>"]
    parts += ["\U0001f600", "\x1c", "\x1f", "\u200b", "_", "-", "\u00df", "\u0130", "\u2028", "\u00e0", "\u00c2", "\u00e2\u20ac", "\x0b", "$$$", "|"]
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(4000)]
    for i in range(0, 4000, 100):
        same_ids(plain, encoder, texts[i : i + 100])


def test_url_rates_are_exact_for_every_section(spark):
    urls_ = [f"http://h.t{k % 300}/s{k % 900}/{i}" for i in range(4) for k in range(900)]
    pages = spark.createDataFrame([(i, u, int(i % 900 % 3 == 0)) for i, u in enumerate(urls_)], "page_id long, url string, y int")
    rows = urls.lexical(urls.parsed(pages).join(pages.select("page_id", "y"), "page_id"))
    model = urls.fit(rows.select("page_id", "url", "host", "path", "y"))
    mean = (1200 + 0.5) / (3600 + 1)
    got = {r.page_id: (r.suffix_rate, r.section_rate) for r in urls._with_rates(rows, model.stats).collect()}
    for i in range(3600):
        # Every 300th, 600th and 900th number has the same rest by 3, so a suffix is all bad or all good.
        bad = i % 900 % 3 == 0
        assert np.allclose(got[i], ((12 * bad + 4 * mean) / 16, (4 * bad + 4 * mean) / 8)), i


def test_url_rates_do_not_give_single_rows_away(spark):
    pages = spark.createDataFrame([(i, f"http://h.com/s{i}/x", i % 2) for i in range(400)], "page_id long, url string, y int")
    rows = urls.lexical(urls.parsed(pages).join(pages.select("page_id", "y"), "page_id"))
    model = urls.fit(rows.select("page_id", "url", "host", "path", "y"))
    assert {r.section_rate for r in urls._with_rates(rows, model.stats, folds=True).collect()} == {model.stats[1]}
