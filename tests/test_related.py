"""Related items where most items are alike: null, empty and starred values, against plain Python."""

import random

from memlens.operators import retrieval as R

ITEMS = "item_id long, repo string, kind string, author string"


def test_alike_items_are_looked_up_once(spark):
    rnd = random.Random(4)
    items = [(i, rnd.choice(["r0", "r1", None]) if i < 90 else "r2", rnd.choice(["issue", "*", None]), rnd.choice(["u", "v", "", None])) for i in range(3000)]
    files = [(i, rnd.randrange(40)) for i in range(90) for _ in range(2)] + [(i, 1000 + i // 2) for i in range(90, 3000)]
    labels = sorted({(i, rnd.choice(["l", "m"])) for i in range(0, 3000, 2)})
    fs, ls = {}, dict(labels)
    for i, f in files:
        fs.setdefault(i, set()).add(f)
    tables = (spark.createDataFrame(items, ITEMS), spark.createDataFrame(files, "item_id long, file_id long"), spark.createDataFrame(labels, "item_id long, label string"))
    got = {}
    for r in R.related_items(*tables, k=3, hot_items=4).collect():
        got.setdefault(r.item_id, []).append((r["rank"], -r.score, r.related_id))
    for i, repo, kind, author in items[:120]:
        scored = []
        for j, other, kind_, author_ in items:
            s = 4 * len(fs[i] & fs[j]) + 2 * (i in ls and ls.get(j) == ls[i]) + (kind is not None and kind == kind_) + (author is not None and author == author_)
            if i != j and repo is not None and repo == other and s:
                scored.append((-s, j))
        assert [x[1:] for x in sorted(got.get(i, []))] == sorted(scored)[:3]
