"""Kinds of RDF terms and the IRIs that the engine knows."""

IRI, LITERAL, BNODE = "iri", "literal", "bnode"

# Public RDF and schema vocabularies.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"

TRIPLES = "graph string, s_kind string, s string, p string, o_kind string, o string, o_lang string, o_datatype string"
