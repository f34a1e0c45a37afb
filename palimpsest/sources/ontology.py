"""Vocabularies in RDF/XML, read on the driver (they are small): hierarchies and labels."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from ..plans.infer import Ontology

RDF, RDFS, OWL = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}", "{http://www.w3.org/2002/07/owl#}"


def _local(uri: str) -> str:
    return uri.rsplit("#", 1)[-1].rsplit("/", 1)[-1]


def read_ontology(texts: list[str]) -> tuple[Ontology, list[tuple[str, str]]]:
    """Hierarchies and (class, label) pairs of RDF/XML documents."""
    classes, properties, labels = [], [], []
    for text in texts:
        for e in ET.fromstring(text):
            name = e.get(f"{RDF}about") or e.get(f"{RDF}ID")
            if not name:
                continue
            name = _local(name)
            for tag, out in (("subClassOf", classes), ("subPropertyOf", properties)):
                out += [(name, _local(x.get(f"{RDF}resource"))) for x in e.findall(f"{RDFS}{tag}") if x.get(f"{RDF}resource")]
            if e.tag == f"{OWL}Class":
                labels += [(name, x.text) for x in e.findall(f"{RDFS}label") if x.text]
    return Ontology(classes, properties), labels


def load_ontology(spark: SparkSession, path: str) -> tuple[Ontology, DataFrame]:
    """Of the files under a path: the hierarchies, and the labels as facts."""
    texts = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    ontology, labels = read_ontology(texts)
    return ontology, spark.createDataFrame([(c, "label", t) for c, t in labels], "s string, p string, o string")
