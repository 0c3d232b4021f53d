import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    names = rel.columns
    return [dict(zip(names, r, strict=True)) for r in rel.fetchall()]


def rows(df):
    return [r.asDict() for r in df.collect()]


def same(a, b, digits=6):
    def norm(rs):
        return sorted((tuple(round(v, digits) if isinstance(v, float) else v for _, v in sorted(r.items())) for r in rs), key=str)

    assert len(a) == len(b)
    assert {k for r in a for k in r} == {k for r in b for k in r}
    for x, y in zip(norm(a), norm(b), strict=True):
        assert x == y
