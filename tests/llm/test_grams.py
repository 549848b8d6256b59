from claimweave.llm import toxicity


def test_every_gram_is_counted(spark):
    """Rare grams of many stay in the model, whatever their number and whatever the number of rows in the regression."""
    rows = [(i, f"w{i:06d}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(d, labels, rows=10)
    told = labels.where(~toxicity.held_out()).selectExpr("doc_id", "pmod(xxhash64(doc_id, 7), 3) = 0 fits").where("not fits").collect()
    expected = {g for r in told for g in toxicity._grams(f"w{r.doc_id:06d}")}
    assert len(told) > 200 and set(model.ratios[0]) == expected and set(model.ratios[1]) == {g[1:] for g in expected}


def brute_ratio(counts, word):
    """The length-normalised log ratio of a word by interpolated Kneser-Ney, straight from the definition."""
    import math
    from collections import Counter, defaultdict

    n, d = toxicity.ORDER, toxicity._DISCOUNT
    low = {c: Counter(g[1:] for g, x in counts.items() if x[c] > 0) for c in (0, 1)}
    pooled = Counter(g[1:] for g in counts)
    shared = []
    for _ in range(2):
        totals = defaultdict(int)
        for g, x in pooled.items():
            totals[g[:-1]] += x
        shared.append({g: x / totals[g[:-1]] for g, x in pooled.items()})
        pooled = Counter(g[1:] for g in pooled)

    def p(gram, table, base):
        context = [x for g, x in table.items() if g[:-1] == gram[:-1] and x > 0]
        if not context:
            return base
        return max(table.get(gram, 0) - d, 0) / sum(context) + d * len(context) / sum(context) * base

    total = 0.0
    for gram in toxicity._grams(word):
        high = {c: {g: x[c] for g, x in counts.items()} for c in (0, 1)}
        if gram in counts:
            base = shared[0].get(gram[1:], 1e-6)
            total += math.log(p(gram, high[1], base) / p(gram, high[0], base))
            continue
        weight = [d * len(s) / sum(s) if (s := [x[c] for g, x in counts.items() if g[:-1] == gram[:-1] and x[c] > 0]) else 1.0 for c in (0, 1)]
        total += math.log(weight[1] / weight[0])
        shorter = gram[1:]
        if shorter in low[0] or shorter in low[1]:
            base = shared[1].get(shorter[1:], 1e-6)
            total += math.log(p(shorter, low[1], base) / p(shorter, low[0], base))
        else:
            weight = [d * len(s) / sum(s) if (s := [x for g, x in low[c].items() if g[:-1] == shorter[:-1]]) else 1.0 for c in (0, 1)]
            total += math.log(weight[1] / weight[0])
    return total / (len(word) + 1)


def test_ratios_follow_the_definition(spark):
    """Seen words, unseen words of seen parts and wholly unseen ones."""
    words = {0: ["table", "tables", "stable", "cable", "garden"], 1: ["tablex", "zwurg", "zwurgs", "garder", "tables"]}
    counts = {}
    for c, some in words.items():
        for w in some:
            for g in toxicity._grams(w):
                counts.setdefault(g, [0.0, 0.0])[c] += 1
    model = toxicity.Model.fit(spark.createDataFrame([(g, *x) for g, x in counts.items()], "gram string, o double, t double"))
    for w in ("table", "zwurg", "zwurgtable", "gardens", "qqq", "a"):
        assert abs(model.word(w) - brute_ratio(counts, w)) < 1e-9, w
