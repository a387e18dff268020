"""Porter stems (examples of the published algorithm, extended mode), lemma vocabulary rules, encoding."""

from pyspark.sql import functions as F

from revforge.functions.porter import stem
from revforge.operators import textops

# ---- fixed values: word -> stem pairs from the published description of the algorithm --------
PORTER_EXAMPLES = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
    "activate": "activ", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "generalizations": "gener",
    "oscillators": "oscil", "enjoy": "enjoy", "say": "say", "dying": "die", "dies": "die", "died": "die",
    "news": "news", "skies": "sky", "cried": "cri", "geology": "geolog", "rationally": "ration",
    "y" * 5000: "y" * 4999 + "i",
}


def test_porter_examples():
    bad = {w: stem(w) for w, s in PORTER_EXAMPLES.items() if stem(w) != s}
    assert not bad


def test_stem_vocabulary_udf(spark):
    toks = spark.createDataFrame([(1, 0, "Running"), (1, 1, "cats"), (2, 0, "cats")], "row_id long, pos int, term string")
    got = {r.term: r.stem for r in textops.stem_vocabulary(toks).collect()}
    assert got == {"Running": "run", "cats": "cat"}


def test_lemma_vocabulary(spark):
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate(["apps", "app", "boxes", "men", "Apps", "glass"])],
                                 "row_id long, pos int, term string")
    lex = spark.createDataFrame([("apps",), ("app",), ("boxes",), ("box",), ("men",), ("man",), ("glass",)], "word string")
    got = {r.term: r.lemma for r in textops.lemma_vocabulary(textops.vocabulary(toks), lex).collect()}
    assert got == {"apps": "app", "app": "app", "boxes": "box", "men": "man", "Apps": "Apps", "glass": "glass"}


def test_encode_fixed(spark):
    docs = spark.createDataFrame([(1, "a b a zz"), (2, "")], "row_id long, review string")
    toks = textops.token_table(docs)
    vocab = spark.createDataFrame([("a", 10, 4), ("b", 5, 5)], "word string, freq long, token_id int")
    enc = {r.row_id: r for r in textops.encode_fixed(docs, toks, vocab, length=8).collect()}
    assert enc[1].input_ids == [2, 4, 5, 4, 1, 3, 0, 0] and enc[1].attention_mask == [1] * 6 + [0, 0]
    assert enc[2].input_ids == [2, 3] + [0] * 6
    long = spark.createDataFrame([(3, " ".join(["a"] * 20))], "row_id long, review string")
    e = textops.encode_fixed(long, textops.token_table(long), vocab, length=8).first()
    assert e.input_ids == [2, 4, 4, 4, 4, 4, 4, 3]


def test_vocab_fit_ties_by_term(spark):
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate(["b", "a", "B", "c", "a"])],
                                 "row_id long, pos int, term string")
    got = [(r.word, r.token_id) for r in textops.vocab_fit(toks, 2).orderBy("token_id").collect()]
    assert got == [("a", 4), ("b", 5)]
    assert F is not None


def test_mapped_lists_equal_mapped_tokens(spark):
    """Lists meet their mapping by blocks of distinct terms: the rows of ``map_terms``, lists of one (or no) key merged."""
    texts = [(i, " ".join(f"w{(i * k) % 41}s Boxes the" for k in range(i % 5))) for i in range(60)]
    texts += [(7, "apps w3s the"), (None, "men the"), (None, "a b c"), (99, ""), (98, None)]
    docs = spark.createDataFrame(texts, "row_id long, review string")
    toks = textops.token_table(docs)
    mapping = textops.stem_vocabulary(toks).filter("term <> 'w3s'")  # a term without a value stays as it is
    lists = textops.token_lists(docs)
    got = textops.map_token_lists(lists, mapping, "stem")
    assert sorted(got.collect(), key=str) == sorted(textops.map_terms(toks, mapping, "stem").collect(), key=str)


def test_mapped_lists_shuffle_no_token(spark):
    """Only whole lists and distinct terms of blocks are exchanged: no exchange has a position."""
    lists = textops.token_lists(spark.createDataFrame([(1, "a b a")], "row_id long, review string"))
    plan = textops.map_token_lists(lists, textops.stem_vocabulary(textops.listed_terms(lists)), "stem")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan and "collect_list" not in plan


def test_keyed_layout_has_parts_of_one_size(spark, monkeypatch):
    """A larger input gets more parts, not larger ones; the aggregate by text and term adds no exchange."""
    from revforge.operators import layout, nb
    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "uid long, review string")
    cores = spark.sparkContext.defaultParallelism
    sizes = []
    for mb in (1, 100, 1000):
        monkeypatch.setattr(layout, "input_bytes", lambda df, mb=mb: mb << 20)
        sizes.append(layout.by_key(docs, "uid").rdd.getNumPartitions())
    assert sizes == [cores, max(cores, 13), 125]
    plan = nb.term_frequencies(textops.token_table(docs, key="uid", keyed=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
