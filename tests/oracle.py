"""Hold a query against its SQL: the same columns, and the same rows in any order."""


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def assert_same(df, duck, sql):
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    expected = rows_of(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected
