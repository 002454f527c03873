import random

import pytest

from folioflow.llm.stuffing import Compressors, dictionaries, matter, spam_page, stuffed_pages

WHO = "The council of the town|A crowd of many people|The harbour office|Captain Hill|The school board|A young teacher|The fire brigade|A farmer near Orham|The widow Norby|The market hall".split("|")
DID = "opened|praised|refused to pay for|spoke at length about|has agreed to repair|collected signatures against|bought|complained about|will sell by auction|asked for money for".split("|")
WHAT = "the old bridge|the new railway line|the flooded meadows|the price of coal|the reading room|the steam tram|two dozen lamps|a stolen clock|the north quay|the winter fair".split("|")
WHEN = "last Tuesday evening|in spite of heavy rain|at the request of the guild|before a large audience|until the end of the season|as our reporter learned|without a single vote against|to the surprise of many".split("|")
SENTENCES = ["The council of the town opened the old bridge on Tuesday evening."]


def article(rng, n=12):
    import textwrap

    return "\n".join(textwrap.wrap(" ".join(f"{rng.choice(WHO)} {rng.choice(DID)} {rng.choice(WHAT)} {rng.choice(WHEN)}." for _ in range(n)), 50))


rng = random.Random(6)
TOWN = lambda: rng.choice("NMSTW") + rng.choice(["or", "est", "ill", "aver", "unter"]) + rng.choice(["ham", "ford", "by", "wick", "stoke", "ton"])
SPAM = {
    "keywords": "\n".join(", ".join(f"{rng.choice(['cheap', 'buy', 'best', 'sale'])} {rng.choice(['shoes', 'lamps'])}" for _ in range(4)) for _ in range(12)),
    "places": "\n".join(f"cheap shoes {TOWN()} cheap shoes {TOWN()}" for _ in range(14)),
    "links": "\n".join(f"http://{TOWN().lower()}.example/{rng.randint(1, 99)}" for _ in range(15)),
    "link list": "\n".join(f"Best lamps - {TOWN().lower()}-shop.example (new)" for _ in range(12)),
    "menu": "\n".join("Home | Login | Shoes | Contact | Archive" for _ in range(10)),
    "tags": "\n".join(f"#cheap{rng.choice(['shoes', 'lamps'])} #buy_{rng.choice(['shoes', 'lamps'])}" for _ in range(14)),
    "products": "\n".join(f"Shoes {TOWN()} {rng.randint(10, 99)}-{rng.randint(100, 999)} size 38 39" for _ in range(12)),
}
NONE = {
    "results": "\n".join(f"{TOWN()} {rng.randint(0, 5)} : {rng.randint(0, 5)} {TOWN()}" for _ in range(15)),
    "prices": "\n".join(f"{rng.choice(['Wool', 'Oats'])} {rng.randint(10, 40)}s. {rng.randint(1, 9)}d. to {rng.randint(50, 90)}s." for _ in range(15)),
    "timetable": "\n".join(f"{rng.randint(1, 23)}.{rng.randint(10, 59)} {TOWN()} dep. {rng.randint(1, 23)}.{rng.randint(10, 59)} arr. {TOWN()}" for _ in range(12)),
    "contents": "\n".join(f"News from {TOWN()} . . . . . {rng.randint(1, 9)}" for _ in range(12)),
    "names": "\n".join(f"Mrs. {TOWN()}, Mr. {TOWN()}, Rev. {TOWN()};" for _ in range(12)),
    "article with links": article(rng) + "\nwww.town.example/3\nPrice 3d. per box\n" + article(rng),
    "article": article(rng), "blank": " \n ", "empty": "", "null": None, "one word": "Hello",
}


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    rows = [(k, article(r), "en", "a") for k in range(80)] + [(200 + k, t, "en" if k % 2 else None, "a") for k, t in enumerate(SPAM.values())] + [(300 + k, t, "en", "a") for k, t in enumerate(NONE.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, spam string")


def test_spam_and_lists_that_inform(corpus):
    got = {r.doc_id for r in stuffed_pages(corpus).where("spam").collect()}
    names = {200 + k: n for k, n in enumerate(SPAM)} | {300 + k: n for k, n in enumerate(NONE)}
    assert {names.get(k, k) for k in got} == set(SPAM)


def test_mixed_pages(corpus):
    c = Compressors(dictionaries(corpus))
    r = random.Random(1)
    spam = "\n".join([SPAM["keywords"], SPAM["links"]])
    assert spam_page(SENTENCES[0] + "\n" + spam, "en", c)[3] and spam_page(spam, "xx", c)[3] and spam_page(spam, None, Compressors({}))[3]
    assert not spam_page(article(r, 20) + "\n" + SPAM["menu"], "en", c)[3]
    assert spam_page(spam * 200, "en", c)[3] and not spam_page(article(r, 2_000), "en", c)[3]


def test_matter_and_dictionaries(spark, corpus):
    assert matter("") == (0.0, 0.0) and matter("www.a.example")[0] == 1.0
    texts = dictionaries(corpus, sample=16)
    assert set(texts) == {"en"} and len(texts["en"]) <= 60_000 and texts == dictionaries(corpus.repartition(5), sample=16)
    assert dictionaries(corpus.where("false")) == {} and stuffed_pages(corpus.where("false")).count() == 0
    assert stuffed_pages(corpus).count() == corpus.count()
    twice = corpus.where("doc_id = 200").unionByName(corpus.where("doc_id = 200"))
    assert stuffed_pages(twice).where("spam").count() == 2


def test_dictionaries_take_whole_pages(spark):
    r = random.Random(5)
    pages = [article(r, 80) for _ in range(8)]
    assert all(5_000 < len(p) < 7_400 for p in pages)
    texts = dictionaries(spark.createDataFrame([(k, p, "en") for k, p in enumerate(pages)], "doc_id long, text string, lang string"))
    assert all(p.encode() in texts["en"] for p in pages)
    assert dictionaries(spark.createDataFrame([(k, p, "en") for k, p in enumerate(pages[:1])], "doc_id long, text string, lang string")) == {"en": pages[0].encode() + b"\n"}  # as many pages as there are
