import pytest
from pyspark.sql import functions as F

from tessera.llm import encoding, mixing


def test_mix(spark):
    rows = [(i, f"word{i} " * (20 + i % 30), ("big", "Mid_Size", "small")[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(3000)]
    rows += [(9000, None, "big"), (9001, "", "big"), (9002, "no source", None), (9003, "other", "untargeted"), (9004, rows[9][1], "SMALL"), (None, "no id", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"weight": F.lit(0), "block": F.lit("clash")})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid-size", 0.2, 2), ("small", 0.3, 4), ("missing", 0.1, 1)], "source string, weight double, max_repeats int")
    mix, shares = mixing.mix(docs, targets)
    m = mix.toPandas()
    s = {r["source"]: r for r in shares.collect()}
    assert s["missing"]["share"] == 0 and s["missing"]["tokens"] == 0
    for k, w in (("big", 0.5), ("mid-size", 0.2), ("small", 0.3)):
        assert abs(s[k]["share"] - w) < 0.02 and s[k]["most_repeats"] <= s[k]["cap"]
    assert not m.duplicated(["doc_id", "repeat_no"]).any()
    assert m.groupby(["doc_id"]).size().max() <= 4 and s["small"]["most_repeats"] >= 3 and s["big"]["most_repeats"] == 1
    first = m[m.slot < m.slot.max() / 4].groupby("source").n_tokens.sum()
    assert abs(first["big"] / first.sum() - 0.5) < 0.08  # the mix is even all the way
    again = mixing.mix(docs, targets)[0].toPandas()
    assert sorted(map(tuple, m.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    empty, sh = mixing.mix(docs.where("false"), targets)
    assert empty.count() == 0 and sh.count() == 4
    assert mixing.mix(docs, targets.where("false"))[0].count() == 0


def test_scarce_source_does_not_set_the_total(spark):
    rows = [(i, f"word{i} " * 40, "big" if i % 2 else "mid") for i in range(2000)] + [(9000 + i, f"a rare text, number {i} " * 30, "scarce") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.25, 1), ("scarce", 0.15, 3)], "source string, weight double, max_repeats int")
    size = {r["source"]: r["t"] for r in mixing.sized(docs, mixing.clean_targets(targets)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    got = {r["source"]: r for r in mixing.mix(docs, targets)[1].collect()}
    total = sum(size.values())
    assert abs(got["big"]["tokens"] - min(0.6 * total, size["big"])) < 0.03 * total and abs(got["mid"]["tokens"] - 0.25 * total) < 0.03 * total
    assert got["scarce"]["most_repeats"] == 3 and got["scarce"]["documents"] == 12 and 2.7 * size["scarce"] < got["scarce"]["tokens"] <= 3 * size["scarce"]
    assert got["scarce"]["share"] < 0.1 and abs(sum(r["share"] for r in got.values()) - 1) < 1e-9
    exact = {r["source"]: r for r in mixing.mix(docs, targets, exact=True)[1].collect()}
    assert all(abs(exact[k]["share"] - w) < 0.02 for k, w in (("big", 0.6), ("mid", 0.25), ("scarce", 0.15)))
    few = mixing.mix(docs, targets, total_tokens=20_000)[1].agg(F.sum("tokens")).first()[0]
    assert abs(few - 20_000) < 1_500


def test_lattice_counts():
    n, w = 10_000, 0.37
    hits = sum((i * mixing.STEP) % mixing.LATTICE < w * mixing.LATTICE for i in range(n))
    assert abs(hits - n * w) < 8


CLEAN = [
    "ATENÇÃO: o índice SÃO PARTE DA LIÇÃO, não é à toa.", "Il faut éviter d'ouvrir la fenêtre – “déjà” vu à côté… œuvre", "Größe über 10 µs × 5 €; 40 °C", "Если индекс пуст, то каталог сначала выбирает первые записи. ВЕРНЫЙ ОТВЕТ",
    "昨日から索引が削除されず、検索結果だけが残っています。", "¿Por qué la búsqueda aparece vacía?", "Każdy błąd trafia tam, źródłowy żeton", "├── a.py\n│   └── b.md", "plain ascii", "When a reader shows `Ã©` instead of one letter", "x² + y³ ≤ 10 ± 1",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert encoding.repair(text)[0] is False


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866"])
@pytest.mark.parametrize("text", ["Größe über später", "Où trouver la clé planifiée ? Voilà ce que l'élément devrait préciser", "It’s the reader’s job — “really”"])
def test_utf8_read_as(read, text):
    to = {b: c for c, b in encoding.tables(read)[0].items()}
    bad = "".join(chr(b) if b < 128 else chr(to[b]) for b in text.encode())
    assert encoding.repair(bad) == (True, text, 1, True)
    assert encoding.repair("Clean first line, é.\n" + bad)[1] == "Clean first line, é.\n" + text


def test_other_layers():
    t = "Danach wird die Änderung gelöscht, und das Gedächtnis bleibt für später gültig"
    once = "".join(chr({b: c for c, b in encoding.tables("cp1252")[0].items()}.get(b, b)) for b in t.encode())
    double = "".join(chr({b: c for c, b in encoding.tables("cp1252")[0].items()}.get(b, b)) for b in once.encode())
    assert encoding.repair(double) == (True, t, 2, True)
    ru = "Почему каталог оказался сжат, объясняет указатель за прошлую неделю"
    assert encoding.repair(ru.encode("koi8_r").decode("cp1251"))[:2] == (True, ru)
    assert encoding.repair("résumé é côté déjà".encode("cp1252").decode("cp850"))[:2] == (True, "résumé é côté déjà")
    assert encoding.repair("It�s lost")[0] is True and encoding.repair("It�s lost")[3] is False


def test_operator(spark):
    rows = [(1, "Ã¼ber die BrÃ¼cke"), (2, "über"), (3, None), (4, ""), (5, "ascii"), (6, "x" * 200_000 + " Ã¤ndern")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"garbled": F.lit("clash"), "restored": F.lit(1)})
    got = {r["doc_id"]: r["restored"] for r in encoding.garbled(df).collect()}
    assert got == {1: "über die Brücke", 6: "x" * 200_000 + " ändern"}
    assert encoding.garbled(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["laq\xaduelle reste juste", "pré\xadcise tâ\xadche ver\xadändert nã\xado", "Sup­pose a ​folder", "amanhã… été” CAFÉ’S résumé…", "Brand™ © 2020"])
def test_soft_hyphens_and_quotes_are_clean(text):
    assert encoding.repair(text)[0] is False


def test_lower_cased_afterwards():
    assert encoding.repair("see the cafã© rã©sumã©â€¦") == (True, "see the café résumé…", 1, True)


@pytest.mark.parametrize("text", ["— voilÃ le cache", "un dÃjà vu", "le cafĆ© noir"])
def test_garbled_beyond_repair(text):
    assert encoding.repair(text) == (True, text, 0, False)
    found, restored, layers, complete = encoding.repair("Ã¼ber die BrÃ¼cke\nclean\n" + text)
    assert found and restored.startswith("über die Brücke\nclean\n") and layers == 1 and not complete


@pytest.mark.parametrize("text", ["Python版の索引", "a&lt;&gt;b &amp;&amp; c", "Ærø, Þór, Ångström", "a │ b ├ c", "SÃO ÀS MAÇÃS", "№ 5 · §3 † ‡"])
def test_odd_but_clean(text):
    assert encoding.repair(text)[0] is False


def _read(text, written, read):
    to = {b: c for c, b in encoding.tables(read)[0].items()}
    return "".join(chr(b) if b < 128 else chr(to[b]) for b in text.encode(written))


@pytest.fixture(scope="module")
def model(spark, data):
    return encoding.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("written,read,text", [
    ("cp1251", "koi8_r", "Привет мир, каталог уже открыт"), ("koi8_r", "cp1251", "## Когда сборщик больше 32 строк, индекс закрыт"), ("cp866", "cp1251", "Если индекс пуст, каталог выбирает записи"),
    ("cp850", "cp1252", "Där steht der Schlüssel später für die Größe über alles"), ("utf-8", "cp1250", "Où trouver la clé planifiée ? Voilà l'élément à côté"), ("shift_jis", "cp1252", "昨日から索引が削除されず、検索結果だけが残っています。"),
])
def test_the_likeliest_repair_is_taken(model, written, read, text):
    assert encoding.repair(_read(text, written, read), model)[:2] == (True, text)


def test_long_lines_are_treated_like_short_ones(model):
    unit = "昨日から索引が削除されず、検索結果だけが残っています。"
    for n in (7_900, 8_100, 200_000):
        text = (unit * (n // len(unit) + 1))[: n // 3]
        assert encoding.repair(_read(text, "utf-8", "latin-1"), model) == (True, text, 1, True)


@pytest.mark.parametrize("text", ["See `cafÃ© crÃ¨me brÃ»lÃ©e` for the name.", "See “la crÃ¨me brÃ»lÃ©e du cafÃ©, comme toujours, avec du sucre” here."])
def test_garbled_words_in_quotes_are_garbled(text):
    found, restored, _, complete = encoding.repair(text)
    assert found and complete and "crème brûlée" in restored


@pytest.mark.parametrize("text", CLEAN + ["resolve({ index: 248, ranking: ’attach stale cache’ });", "`Ã© Ã¼ â€™ Ã±` are the usual signs, `Â ` too"])
def test_clean_with_a_model(model, text):
    assert encoding.repair(text, model)[0] is False


def test_the_model_counts_every_clean_document(spark):
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("é "), "id")).when(F.col("id") % 3 == 1, F.concat(F.lit("Größe\n"), "id", F.lit(" – œuvre"))).when(F.col("id") % 50 == 2, "Ã¼ber die BrÃ¼cke")
    docs = spark.range(60_000).select(text.alias("text"))
    assert encoding.cost("Ã¼ber die BrÃ¼cke") > 0
    slots = encoding.np.concatenate([encoding.pair_slots("é 0"), encoding.pair_slots("Größe\n1 – œuvre")])
    want = encoding.Model(20_000 * encoding.np.bincount(slots, minlength=encoding.TABLE))
    assert (encoding.fit(docs).cost == want.cost).all()


def test_lines_looked_up_at_once_are_doubted_alike(model):
    texts = [*CLEAN, "зКСРШЯ ОПХБЕР ЙЮРЮКНЦ", "plain\n\nбЯЕ ОЕПБШЕ ГЮОХЯХ ХМДЕЙЯЮ\né", "\n", "\ud800é\r\nøøøøøø", "日本" * 40_000 + "\nåäåäåä"]
    texts += [a + "\n" + b for a in texts for b in texts[:-1]]
    doubted = [[line for line in t.split("\n") if encoding.unlikely(line, model)] for t in texts]
    assert [encoding.unlikely_lines(t, model) for t in texts] == doubted and 0 < sum(map(bool, doubted)) < len(texts)


def test_garbled_lines_that_look_clean_do_not_teach_the_model(spark):
    bad = "There are ôshallowö entries"
    assert encoding.looks_clean(bad)
    clean = F.concat(F.lit("Größe über später, déjà vu à côté "), "id")
    docs = spark.range(20_000).select(F.when(F.col("id") < 4, bad).otherwise(clean).alias("text"))
    fitted = encoding.fit(docs)
    n = encoding.np.bincount(encoding.pair_slots("Größe über später, déjà vu à côté "), minlength=encoding.TABLE)
    assert (fitted.cost == encoding.Model(19_996 * n).cost).all()
