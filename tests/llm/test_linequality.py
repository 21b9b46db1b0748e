import re
from collections import Counter

from tillwork.llm import linequality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def normal(line):
    return re.sub("[0-9]+", "0", " ".join(WORD.findall(line)).lower())


def plain(rows, least, min_words):
    docs, of_host = {}, {}
    for i, text, host in rows:
        of_host.setdefault(host, set()).add(i)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                docs.setdefault((host, normal(line)), set()).add(i)
    out = []
    for i, text, host in rows:
        m = measures(text)
        failed = m[0] < min_words or m[4] > 0.5 * m[0]
        gone = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if WORD.search(x)
                   and len(docs[host, normal(x)] - {None}) > least)
        out.append((str(i), *m, failed, gone, not failed and m[0] - gone >= 0.5 * m[0]))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                   r.n_line_words, r.kept) for r in df.collect())


def hosted():
    body = lambda i: " ".join("word" + "x" * i + "yz"[j % 2] * (j + 1) for j in range(9))
    menu, foot = "Home | About  | Page 12", "Copyright 2020 by Someone"
    rows = []
    for i in range(60):
        host = "a" if i % 3 else None
        text = "\n".join([menu if i % 2 else menu.upper().replace("12", "7"), body(i), body(i + 1), foot, foot] if i < 40 else [body(i)])
        rows.append((i, text, host))
    rows += [(60, f"{menu}\n{foot}\nonly three words", "a"), (61, "x y z " * 9, "b"), (62, "x y z x y z q", "b"), (63, "a b\na b\n a b", "b")]
    return rows


def test_matches_plain_counting(make_docs):
    rows = hosted()
    df = make_docs([(i, t, "en", h) for i, t, h in rows])
    assert got(linequality.judge(df, least=5, min_left=0.5, min_words=4)) == plain(rows, 5, 4)
    kept = {r.doc_id: r for r in linequality.judge(df, least=5, min_left=0.5, min_words=4).collect()}
    assert kept[1].kept and kept[1].n_line_words > 0 and not kept[60].kept


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    assert got(linequality.judge(awkward, least=1, min_left=0.5, min_words=2)) == plain(rows, 1, 2)
    assert linequality.judge(nothing).count() == 0


def test_long_repeats_and_wide_windows(spark):
    texts = ["a " * 3000, "a b c " * 1000 + "d", "x", "a b c d a b c", "a b c a b", " ".join(map(str, range(5000)))]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = linequality.text_measures(df).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text)


def test_plan_is_native(spark, make_docs):
    plan = linequality.judge(make_docs([(1, "a b")]))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("python|arrow|pandas", plan, re.I)


def test_texts_without_frequent_lines(make_docs, awkward):
    df = make_docs([(i, t, "en", h) for i, t, h in hosted()])
    kept = {r.doc_id: r.text for r in linequality.without_frequent_lines(df, least=5).collect()}
    judged = {r.doc_id: r for r in linequality.judge(df, least=5).collect()}
    assert any(judged[i].n_line_words for i in kept)
    assert all(len(t.split()) == judged[i].n_words - judged[i].n_line_words for i, t in kept.items())
    same = linequality.without_frequent_lines(awkward, least=20).select("doc_id", "text").collect()
    assert sorted(map(str, same)) == sorted(map(str, awkward.select("doc_id", "text").collect()))


def test_the_limit_does_not_rise_with_the_host(make_docs):
    small = [(i, f"the same line here\nown line {'abcdefghij'[i]}", "en", "h") for i in range(8)]
    large = small + [(100 + i, f"nothing shared {i * 7 % 901} {'x' * i}", "en", "h") for i in range(900)]
    for rows in (small, large):
        got = linequality.judge(make_docs(rows), least=5, min_words=1).filter("n_line_words > 0").count()
        assert got == 8
