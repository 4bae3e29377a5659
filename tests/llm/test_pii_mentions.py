"""Mentions that ties lead to from base spans: spaced numbers, names without digits, rows 1 and 6 of test_pii."""

import random

import pytest

from waymark.llm import pii


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    many = [f"note {i} mail user{i}@mail.example.com and call +1 (415) 555-{1000 + i} from 10.0.0.{i} ref {rng.randint(100, 99999)}" for i in range(60)]
    many += ["pay 4111111111111111 now. Later the holder wrote 11111111 again", "call +1 (415) 555-0199 or 4155550199 today"]  # as test_pii has it
    many += ["ask hsr.29@mail5.example.com, that is hsr.29 to us", "5927243074273351 and 5927243074273351", "x@y.zz"]
    return pii.fit(pii.examples(many))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("pay 4111111111111111 now. Later the holder wrote 11111111 again", ["card 11111111"]),
        ("ask hsr.29@mail5.example.com, that is hsr.29 to us", ["email hsr.29"]),
        ("mail jane.doe@x.com. Jane.Doe, not jane.doer or xjane.doe", ["email Jane.Doe"]),
        ("联系jane.doe@x.com找jane.doe吧", ["email jane.doe"]),
        ("call +1 415 555 0199. Later 4155550199, 415 555 0199 or (415) 555-0199 7 times", ["phone 4155550199", "phone 415 555 0199", "phone (415) 555-0199"]),
        ("later 020 7946 0958, first +44 20 7946 0958", ["phone 020 7946 0958"]),
        ("card 4111 1111 1111 1111, then 1111 1111 1111 end", ["card 1111 1111 1111"]),
        ("contact contact@x.com for contact", []),
        ("call +1 415 555 0199 about 415 555 0198 and 12 555 0200", []),
        ("call +1 415 555 0199, ISBN 9784155550199 or 978-4-155550-199, id 0004155550199, 0014155550199 and 04155550199", ["phone 0014155550199", "phone 04155550199"]),
        ("mail will@firm.com, he will and Will did; reach will@office", ["email will@office"]),
        ("2024@x.com in 2024 or 2024, well-known@x.com is well-known, e.g. U.s.a. of u.s.a@x.com", []),
        (f"mail a{'1234567890' * 3}@x.com: {'1234567890' * 3} or 9{'1234567890' * 3}", ["email " + "1234567890" * 3]),
    ],
)
def test_mentions(model, text, want):
    spans = pii.base_spans(text)
    assert spans
    assert [f"{pii.KINDS[k]} {text[a:b]}" for a, k, b in pii.added_spans(text, spans, model)] == want


def test_long_tokens(model):
    head = "1" + "ab," * 200
    g = pii.graph(f"{head}x {head}y {head}x", [])
    assert g.skip == [(0, 2)]
    assert pii._shape(head + "12345678901234567890") == pii._shape("12345678901234567890," * 30 + "a" * 700)
    text = f'{head}"+1 415 555 0199",{head} {head}"4155550199",{head} {head}z'
    assert [text[a:b] for a, _, b in pii.added_spans(text, pii.base_spans(text), model)] == ["4155550199"]


def planted(text, rng):
    """text with one base span of it written once more, in a way that no fit has seen, and where that stands."""
    spans = [(a, k, b) for a, k, b in pii.base_spans(text) if k != 1 and pii._base_keys(text[a:b], k)]
    if not spans:
        return None
    a, k, b = rng.choice(spans)
    if k == 0:
        said = rng.choice(["{}@office", "{}"]).format(pii._name(text[a:b].partition("@")[0]).title())
    else:
        digits = pii._digits(text[a:b])[-10:]
        said = rng.choice(["({}) {}-{}", "{}.{}.{}", "{} / {} / {}"]).format(digits[:-7], digits[-7:-4], digits[-4:]) if len(digits) > 7 else digits
    head = text + rng.choice(["\nSee also: ", "\n\nP.S. reach me under ", " -- filed as "])
    return head + said + rng.choice([" please.", ", as before", "\nThanks"]), len(head), len(head) + len(said), k


def measured(spark, folder):
    """Of texts that are not held out a model; on the others: share of planted mentions found, spans added to texts as they are."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("text IS NOT NULL")
    trained = pii.train(docs.filter("crc32(cast(doc_id AS string)) % 5 <> 0"))
    rng, found, tried, added, chance = random.Random(11), 0, 0, [], 0
    others = [r.text for r in docs.filter("crc32(cast(doc_id AS string)) % 5 = 0").orderBy("doc_id").collect()]
    for n, text in enumerate(others):
        spans = pii.base_spans(text)
        added += [(text[a:b], k) for a, k, b in pii.added_spans(text, spans, trained)]
        if case := planted(text, rng):
            whole, a, b, k = case
            got = pii.added_spans(whole, pii.base_spans(whole), trained)
            if pii._line(pii.base_spans(whole)) == pii._line(spans):  # not itself a match of the patterns
                tried += 1
                found += any(x < b and y > a and kind == k for x, kind, y in got)
        # A number and a name that this text does not know: nothing of them may be added.
        strange = text + f"\nref {rng.randrange(10**9, 10**10)} by {rng.choice(['newton', 'mira.k', 'x9'])}{n}"
        got = pii.added_spans(strange, pii.base_spans(strange), trained)
        chance += any(y > len(text) for _, _, y in got)
    return found, tried, added, chance, len(others)


def test_held_out(spark):
    found, tried, added, chance, texts = measured(spark, "/root/testdata/sf0.1")
    print(f"planted mentions found {found} of {tried}; added to {texts} texts as they are: {added}; strange numbers and names added: {chance}")
    assert tried >= 50 and found >= 0.9 * tried and chance == 0
    assert len(added) <= 0.002 * texts


#: Words, months and given names that are words too.
WORDS = (
    "will mark hope grace april june august summer autumn winter dawn faith joy rose lily daisy ivy violet olive ruby pearl amber jade "
    "crystal melody harmony patience prudence constance chase grant hunter mason carter cooper taylor baker fisher king bishop stone wood "
    "rock dean drew frank rich rusty sandy stormy sunny sterling page reed ward wade heath brook river forest glen cliff dale"
).split()


def common_words(model, texts):
    """Of texts about words, each once more with an address named after it before them, between them and behind: how many words were
    marked, of how many, and of mentions with a host how many were not."""
    wrong, tried, missed = 0, 0, 0
    for n, word in enumerate(WORDS):
        body = f"They {word} it. {word.title()} came, and {word.upper()} too: no {word}, a {word}."
        mail = f"{word}@firm{n}.com"
        for text in (f"{mail} {body}", f"{body} {mail}", f"{mail} {body} {mail}", f"{texts[n % len(texts)]}\n{mail} {body}\nask {mail}, {word} or {mail}"):
            got = pii.added_spans(text, pii.base_spans(text), model)
            tried += text.lower().count(word) - text.count(mail)
            wrong += sum(text[a:b].lower() == word for a, _, b in got)
        said = f"write to {mail} or {word.title()}@office today"
        missed += f"{word.title()}@office" not in [said[a:b] for a, _, b in pii.added_spans(said, pii.base_spans(said), model)]
    return wrong, tried, missed


def test_common_words(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL")
    texts = [r.text for r in docs.filter("crc32(cast(doc_id AS string)) % 5 = 0").orderBy("doc_id").limit(60).collect()]
    trained = pii.train(docs.filter("crc32(cast(doc_id AS string)) % 5 <> 0"))
    for which in (trained, model):
        wrong, tried, missed = common_words(which, texts)
        print(f"addresses named after {len(WORDS)} words: {wrong} of {tried} words marked; with a host {missed} missed")
        assert len(WORDS) >= 50 and wrong <= 0.01 * tried and missed <= 0.1 * len(WORDS)
