"""Small graphs for the tests: base example.com, short names for kinds."""

from citeweave.functions import vocabulary as V
from citeweave.graph import Graph

B = "http://example.com/"
SCHEMES = {"doi": V.DOI, "issn": V.ISSN, "orcid": V.ORCID, "viaf": V.VIAF, "crossref": V.CROSSREF, "wikidata": V.WIKIDATA}


def u(kind, n):
    return f"{B}{kind}/{n}"


def build(spark, br=(), ra=(), ar=(), ids=(), triples=()):
    """br: (n, type, title, date, part_of[, number]); ra: (n, name, given, family); ar: (n, br, role, ra[, next]);
    ids: (n, kind, owner, scheme, literal)."""
    part = lambda kind, n: None if n is None else u(kind, n)
    return Graph.of(
        spark,
        br=[(u("br", b[0]), [V.EXPRESSION, b[1]] if b[1] else [V.EXPRESSION], b[2], None, b[3], b[5] if len(b) > 5 else None, None, part("br", b[4])) for b in br],
        ra=[(u("ra", r[0]), r[1], r[2], r[3]) for r in ra],
        ar=[(u("ar", a[0]), a[2], part("ra", a[3]), part("ar", a[4]) if len(a) > 4 else None) for a in ar],
        ident=[(u("id", i[0]), SCHEMES.get(i[3], i[3]), i[4]) for i in ids],
        br_ar=[(u("br", a[1]), u("ar", a[0])) for a in ar if a[1] is not None],
        ent_id=[(i[1], u(i[1], i[2]), u("id", i[0])) for i in ids if i[2] is not None],
        triples=list(triples),
    )


def golden(spark):
    """Two articles of one DOI with agents of one identifier, in containers whose identifiers differ."""
    return build(
        spark,
        br=[
            (1, V.VOLUME, "BR3_volume", "2020", None), (2, V.ISSUE, "BR3_issue", None, 1), (3, V.ARTICLE, "BR3", "2020-05-01", 2), (4, V.VOLUME, "BR6_volume", "2020", None),
            (5, V.ISSUE, "BR6_issue", None, 4), (6, V.ARTICLE, "BR6", "2020-05-01", 5), (7, V.ARTICLE, "test", "2020-05-01", None),
        ],
        ra=[(1, None, "name", "familyname"), (2, "Pub", None, None), (3, None, "name", "familyname"), (4, "Pub", None, None), (5, None, "othername", "otherfamilyname"), (6, None, "othername", "otherfamilyname")],
        ar=[(1, 3, V.AUTHOR, 1), (2, 3, V.PUBLISHER, 2), (3, 6, V.AUTHOR, 3), (4, 6, V.PUBLISHER, 4), (5, 7, V.AUTHOR, 5), (6, 7, V.AUTHOR, 6)],
        ids=[
            (1, "ra", 1, "orcid", "orcid1"), (6, "ra", 3, "orcid", "orcid1"), (2, "ra", 2, "crossref", "pub1"), (7, "ra", 4, "crossref", "pub1"), (3, "br", 1, "doi", "br3_volume_doi"), (4, "br", 2, "doi", "br3_issue_doi"),
            (5, "br", 3, "doi", "doi1"), (10, "br", 6, "doi", "doi1"), (8, "br", 4, "doi", "br6_volume_doi"), (9, "br", 5, "doi", "br6_issue_doi"), (11, "br", 7, "doi", "doi4"),
            (12, "ra", 5, "orcid", "orcid_author_1"), (13, "ra", 6, "orcid", "orcid_author_1"), (14, "ra", 6, "viaf", "viaf1"),
        ],
    )
