"""IRIs of the bibliographic graph (fixed values of its public ontologies)."""

FABIO, PRO, DATACITE = "http://purl.org/spar/fabio/", "http://purl.org/spar/pro/", "http://purl.org/spar/datacite/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
EXPRESSION = FABIO + "Expression"
JOURNAL, VOLUME, ISSUE, ARTICLE = (FABIO + x for x in ("Journal", "JournalVolume", "JournalIssue", "JournalArticle"))
AUTHOR, EDITOR, PUBLISHER = (PRO + x for x in ("author", "editor", "publisher"))
AGENT_CLASS, ROLE_CLASS, IDENTIFIER_CLASS = "http://xmlns.com/foaf/0.1/Agent", PRO + "RoleInTime", DATACITE + "Identifier"

TITLE, SUBTITLE = "http://purl.org/dc/terms/title", "http://purl.org/spar/fabio/hasSubtitle"
PUB_DATE, PART_OF = "http://prismstandard.org/namespaces/basic/2.0/publicationDate", "http://purl.org/vocab/frbr/core#partOf"
NUMBER, EDITION = FABIO + "hasSequenceIdentifier", "http://prismstandard.org/namespaces/basic/2.0/edition"
CONTRIBUTOR, HAS_ID = PRO + "isDocumentContextFor", DATACITE + "hasIdentifier"
SCHEME, LITERAL = DATACITE + "usesIdentifierScheme", "http://www.essepuntato.it/2010/06/literalreification/hasLiteralValue"
ROLE, HELD_BY, NEXT = PRO + "withRole", PRO + "isHeldBy", "https://w3id.org/oc/ontology/hasNext"
NAME, GIVEN, FAMILY = (f"http://xmlns.com/foaf/0.1/{x}" for x in ("name", "givenName", "familyName"))

DOI, ISSN, ISBN, PMID, PMCID, ORCID, VIAF, WIKIDATA, CROSSREF, OPENALEX = (DATACITE + x for x in ("doi", "issn", "isbn", "pmid", "pmcid", "orcid", "viaf", "wikidata", "crossref", "openalex"))
#: Identifier schemes that the catalogues take for a resource.
RESOURCE_SCHEMES = {DOI: "doi", ISSN: "issn", PMID: "pmid", PMCID: "pmcid"}

#: Snapshots of entities.
PROV = "http://www.w3.org/ns/prov#"
SNAPSHOT, SNAPSHOT_OF, BEGAN, ENDED, DONE_BY, DERIVED_FROM = (PROV + x for x in ("Entity", "specializationOf", "generatedAtTime", "invalidatedAtTime", "wasAttributedTo", "wasDerivedFrom"))
DESCRIPTION, UPDATE, LABEL = "http://purl.org/dc/terms/description", "https://w3id.org/oc/ontology/hasUpdateQuery", "http://www.w3.org/2000/01/rdf-schema#label"
DATE_TIME = "http://www.w3.org/2001/XMLSchema#dateTime"
