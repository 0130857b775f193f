"""Small graphs from literals."""

import hashlib

from kestrel_kg.operators.model import Graph

ENTITIES = "entity_id string, ord long, label string, entity_type string, description string, aliases array<string>, source_chunks array<string>, embedding array<double>, metadata string"
RELATIONS = "relation_index long, subject_id string, predicate string, object_id string, confidence double, source_chunk string, metadata string"
# The classes and triples of the ontology that these graphs follow.
CLASSES = ("Drug", "Condition", "Procedure", "Symptom", "AnatomicalStructure", "DosageRegimen", "LabTest", "Organization", "Other")
SPECS = (
    ("treats", "Drug", "Condition"), ("causes", "Drug", "Symptom"), ("contraindicated_for", "Drug", "Condition"), ("part_of", "Procedure", "Procedure"),
    ("diagnosed_by", "Condition", "LabTest"), ("dosage_is", "Drug", "DosageRegimen"), ("related_to", "Other", "Other"),
)


def eid(label):
    return hashlib.md5(label.lower().encode()).hexdigest()


def graph(spark, entities, relations):
    """entities: (label, type, description, aliases[, vector, chunks]); relations: (subject, predicate, object[, confidence, chunk])."""
    rows = []
    for i, (label, kind, about, aliases, *rest) in enumerate(entities):
        rows.append((eid(label), i, label, kind, about, list(aliases), rest[1] if len(rest) > 1 else [], rest[0] if rest else None, "{}"))
    edges = [(i, eid(s), p, eid(o), rest[0] if rest else 1.0, rest[1] if len(rest) > 1 else None, "{}") for i, (s, p, o, *rest) in enumerate(relations)]
    return Graph(spark.createDataFrame(rows, ENTITIES), spark.createDataFrame(edges, RELATIONS))


def classes(spark):
    return spark.createDataFrame([(c,) for c in CLASSES], "name string")


def specs(spark):
    return spark.createDataFrame([(*s, "") for s in SPECS], "predicate string, domain string, range string, description string")


def leukemia(spark):
    return graph(
        spark,
        [
            ("imatinib", "Drug", "BCR-ABL tyrosine kinase inhibitor", ["Glivec"], [1.0, 0.0, 0.0]),
            ("dasatinib", "Drug", "second generation tyrosine kinase inhibitor", [], [0.9, 0.1, 0.0]),
            ("Ph+ acute lymphoblastic leukemia", "Condition", "Philadelphia-positive acute leukemia", ["Ph+ ALL"], [0.8, 0.2, 0.0]),
            ("RT-PCR", "LabTest", "BCR-ABL molecular diagnostic test", [], [0.0, 1.0, 0.0]),
        ],
        [("imatinib", "treats", "Ph+ acute lymphoblastic leukemia", 0.95), ("dasatinib", "treats", "Ph+ acute lymphoblastic leukemia"), ("Ph+ acute lymphoblastic leukemia", "diagnosed_by", "RT-PCR", 0.9)],
    )
