"""Dumps written, read back, and read from a hand-made file."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from trawl.sources import sqldump

BY_HAND = r"""--
-- A dump
--
CREATE TABLE public.page (
    id integer NOT NULL,
    url character varying(3000),
    priority numeric(6,5),
    seen timestamp without time zone,
    ok boolean DEFAULT true,
    data bytea,
    v vector(3)
);
COPY public.page (id, url, priority, seen, ok, data, v) FROM stdin;
1	http://a/b\tc\\d\ne	0.50000	2024-01-02 03:04:05	t	\\x00ff	[1,2.5,-3]
2	\N	\N	\N	f	\N	\N
3	COPY public.page (id) FROM stdin;	1.00000	2024-01-02 03:04:05.25	t	\\x	[0,0,0]
\.
CREATE TABLE public.link (
    from_page integer,
    note text
);
COPY public.link (note, from_page) FROM stdin;
COPY public.page (id) FROM stdin;	7
\303\251\x41\q	8
	9
\.
SELECT 1;
"""


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_dump_by_hand(spark, tmp_path, split):
    (tmp_path / "a.sql").write_text(BY_HAND)
    path = f"file://{tmp_path}"
    rows = sorted(tuple(r) for r in sqldump.read_dump(spark, path, "public.page", split=split).collect())
    assert rows == [
        (1, "http://a/b\tc\\d\ne", Decimal("0.50000"), datetime(2024, 1, 2, 3, 4, 5), True, b"\x00\xff", [1.0, 2.5, -3.0]),
        (2, None, None, None, False, None, None),
        (3, "COPY public.page (id) FROM stdin;", Decimal("1.00000"), datetime(2024, 1, 2, 3, 4, 5, 250000), True, b"", [0.0, 0.0, 0.0]),
    ]
    links = sqldump.read_dump(spark, path, "public.link", split=split)
    assert links.columns == ["from_page", "note"]
    assert sorted(tuple(r) for r in links.collect()) == [(7, "COPY public.page (id) FROM stdin;"), (8, "éAq"), (9, "")]
    assert [tuple(r) for r in links.filter("from_page = 8").collect()] == [(8, "éAq")] and links.filter("note = 'éAq'").count() == 1
    with pytest.raises(ValueError, match="no table"):
        sqldump.read_dump(spark, path, "public.none")


def test_dump_reads_back(spark, tmp_path):
    odd = ["", None, "\\N", "\\.", "a\tb\nc\rd\be\ff\vg\\h", "\\\\x41", "COPY x (y) FROM stdin;", "ü☃😀", "x" * 300_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id long, `te xt` string").repartition(3)
    sqldump.write_dump(rows, str(tmp_path / "d"), "t", {"id": "bigint", "te xt": "text"})
    sqldump.write_dump(rows.limit(0), str(tmp_path / "d"), "t", {"id": "bigint", "te xt": "text"})
    back = sqldump.read_dump(spark, str(tmp_path / "d"), "t", ("id", "te xt"), split=1000)
    assert sorted((r[0], r[1]) for r in back.collect()) == list(enumerate(odd))
    assert [r[0] for r in back.filter("`te xt` = 'ü☃😀'").collect()] == [7] and back.filter("id in (1, 3)").count() == 2
