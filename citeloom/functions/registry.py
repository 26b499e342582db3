"""The repository registry: a small fixed dimension and what derives from it."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NA = "N/A"


@dataclass(frozen=True)
class Repository:
    """One registry entry. Order in REGISTRY is meaningful (first match wins)."""

    canonical: str
    aliases: tuple[str, ...]
    prefixes: tuple[str, ...]
    shape: str
    group: str
    url: str

    @property
    def names(self) -> tuple[str, ...]:
        return (self.canonical, *self.aliases)


_DOI_SHAPE = r"^10\.\d{4,9}/.+$"
_DOI_URL = "https://doi.org/{id}"

#: Names a JSON file with a list of entries (canonical, aliases, prefixes,
#: identifier_pattern, synonym_group, url_template) that is used instead.
REGISTRY_FILE = "CITELOOM_REGISTRY"


def load_registry(path: str) -> tuple[Repository, ...]:
    """The entries of a JSON file, in its order; only canonical is needed."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)
    entries = entries.get("repositories", []) if isinstance(entries, dict) else entries
    return tuple(
        Repository(e["canonical"], tuple(e.get("aliases") or ()), tuple(e.get("prefixes") or ()), e.get("identifier_pattern") or "", e.get("synonym_group") or e["canonical"].lower(), e.get("url_template") or "") for e in entries
    )


# Names, prefixes, identifier shapes, synonym groups and URL
# templates of the public repositories, in registry order.
REGISTRY = (
    Repository("GEO", ("Gene Expression Omnibus", "NCBI GEO", "GEO", "www.ncbi.nlm.nih.gov/geo", "ncbi.nlm.nih.gov/geo"), ("GSE", "GSM", "GPL"), r"^(GSE|GSM|GPL)\d+$", "geo", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc={id}"),
    Repository("GEO", (), ("GDS",), r"^GDS\d+$", "geo", "https://www.ncbi.nlm.nih.gov/sites/GDSbrowser?acc={id}"),
    Repository("PRIDE", ("PRIDE Archive", "PRIDE", "EBI PRIDE", "www.ebi.ac.uk", "ebi.ac.uk", "www.ebi.ac.uk/pride", "ebi.ac.uk/pride"), ("PXD",), r"^PXD\d+$", "proteomexchange", "https://www.ebi.ac.uk/pride/archive/projects/{id}"),
    Repository("ProteomeXchange", ("ProteomeXchange", "ProteomeCentral", "PX"), (), r"^PXD\d+$", "proteomexchange", "https://proteomecentral.proteomexchange.org/cgi/GetDataset?ID={id}"),
    Repository("MassIVE", ("Massive", "MassIVE", "UCSD MassIVE", "massive.ucsd.edu", "www.massive.ucsd.edu"), ("MSV",), r"^MSV\d+$", "massive", "https://massive.ucsd.edu/ProteoSAFe/dataset.jsp?accession={id}"),
    Repository("jPOST", ("jPOST", "jPOSTrepo", "jpostdb.org", "repository.jpostdb.org", "www.jpostdb.org"), ("JPST",), r"^JPST\d+$", "jpost", "https://repository.jpostdb.org/entry/{id}"),
    Repository("iProX", ("iProX", "iprox.cn", "www.iprox.cn", "www.iprox.org", "iprox.org"), ("IPX",), r"^IPX\d+$", "iprox", "https://www.iprox.cn/page/project.html?id={id}"),
    Repository("PeptideAtlas", ("PeptideAtlas", "PASS"), ("PASS",), r"^PASS\d+$", "peptideatlas", "https://www.peptideatlas.org/PASS/{id}"),
    Repository("PanoramaPublic", ("Panorama Public", "PanoramaPublic", "Panorama"), (), "", "panoramapublic", ""),
    Repository("ArrayExpress", ("ArrayExpress", "EBI ArrayExpress", "BioStudies ArrayExpress"), ("E-MTAB", "E-GEOD", "E-PROT", "E-MEXP"), r"^E-(MTAB|GEOD|PROT|MEXP)-\d+$", "arrayexpress", "https://www.ebi.ac.uk/biostudies/arrayexpress/studies/{id}"),
    Repository("SRA", ("Sequence Read Archive", "SRA", "NCBI SRA", "www.ncbi.nlm.nih.gov/sra", "ncbi.nlm.nih.gov/sra"), ("SRP", "SRR", "SRX", "SRS", "SRA"), r"^SR[PRXSA]\d+$", "ncbi-sra", "https://www.ncbi.nlm.nih.gov/sra/?term={id}"),
    Repository("BioProject", ("BioProject", "NCBI BioProject", "www.ncbi.nlm.nih.gov/bioproject", "ncbi.nlm.nih.gov/bioproject"), ("PRJNA", "PRJEB", "PRJDB"), r"^PRJ(NA|EB|DB)\d+$", "ncbi-sra", "https://www.ncbi.nlm.nih.gov/bioproject/{id}"),
    Repository("BioSample", ("BioSample", "NCBI BioSample"), ("SAMN", "SAMEA", "SAMD"), r"^SAM(N|EA|D)\d+$", "biosample", "https://www.ncbi.nlm.nih.gov/biosample/{id}"),
    Repository("ENA", ("ENA", "European Nucleotide Archive"), ("ERP", "ERR", "ERX", "ERS"), r"^ER[PRXS]\d+$", "ena", "https://www.ebi.ac.uk/ena/browser/view/{id}"),
    Repository("Dryad", ("Dryad", "Dryad Digital Repository"), (), _DOI_SHAPE, "dryad", _DOI_URL),
    Repository("Zenodo", ("Zenodo",), (), _DOI_SHAPE, "zenodo", _DOI_URL),
    Repository("Figshare", ("Figshare", "figshare"), (), _DOI_SHAPE, "figshare", _DOI_URL),
    Repository("Dataverse", ("Dataverse", "Harvard Dataverse"), (), _DOI_SHAPE, "dataverse", _DOI_URL),
    Repository("MendeleyData", ("Mendeley Data", "MendeleyData", "data.mendeley.com"), ("10.17632",), r"^10\.17632/.+$", "mendeleydata", _DOI_URL),
    Repository("dbGaP", ("dbGaP", "dbGap", "dbGAP", "dBGaP", "database of Genotypes and Phenotypes", "www.ncbi.nlm.nih.gov/projects/gap", "ncbi.nlm.nih.gov/projects/gap"), ("phs",), r"^phs\d+(\.v\d+)?(\.p\d+)?$", "dbgap", "https://www.ncbi.nlm.nih.gov/projects/gap/cgi-bin/study.cgi?study_id={id}"),
    Repository("PDB", ("PDB", "Protein Data Bank", "RCSB PDB", "wwPDB", "www.rcsb.org", "rcsb.org", "www.wwpdb.org"), (), r"^[0-9][A-Za-z0-9]{3}$", "pdb", "https://www.rcsb.org/structure/{id}"),
    Repository("EGA", ("EGA", "European Genome-Phenome Archive", "European Genome Phenome Archive", "ega-archive.org", "www.ega-archive.org"), ("EGAS", "EGAD"), r"^EGA[SD]\d+$", "ega", "https://ega-archive.org/studies/{id}"),
    Repository("DepMap", ("DepMap", "Dependency Map", "Cancer Dependency Map"), (), "", "depmap", "https://depmap.org/portal/download/all/?releasename={id}"),
    Repository("PDC", ("PDC", "Proteomic Data Commons", "Proteomic Data Commons (PDC)"), ("PDC",), r"^PDC\d+$", "pdc", "https://pdc.cancer.gov/pdc/study/{id}"),
    Repository("HumanProteinAtlas", ("Human Protein Atlas", "HPA"), (), "", "hpa", "https://www.proteinatlas.org/{id}"),
    Repository("DOI", ("DOI",), (), _DOI_SHAPE, "doi", _DOI_URL),
)
if os.environ.get(REGISTRY_FILE):
    REGISTRY = load_registry(os.environ[REGISTRY_FILE])
# Prefixes of identifiers that are written in upper case.
UPPER_PREFIXES = (
    "GSE", "GSM", "GPL", "GDS", "PXD", "MSV", "JPST", "IPX", "PASS", "E-MTAB", "E-GEOD", "E-PROT", "E-MEXP", "SRP", "SRR", "SRX",
    "SRS", "SRA", "PRJNA", "PRJEB", "PRJDB", "SAMN", "SAMEA", "SAMD", "ERP", "ERR", "ERX", "ERS", "EGAS", "EGAD", "PDC",
)


def _alternation(values) -> str:
    """Distinct values, longest first, quoted for Java and RE2 alike."""
    return "|".join(re.escape(v).replace(r"\ ", " ").replace("/", "/") for v in sorted(dict.fromkeys(values), key=lambda v: -len(v)))


def factored(values) -> str:
    """The same alternatives as _alternation(), with shared beginnings written once: a place is tried by its first letters, not by every value."""
    tree: dict = {}
    for value in dict.fromkeys(values):
        node = tree
        for letter in value:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [re.escape(letter).replace(r"\ ", " ") + written(below) for letter, below in node.items() if letter]
        body = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})" if parts else ""
        return f"{body}?" if parts and "" in node else body

    return written(tree)


ACCESSION = rf"\b(?:{_alternation(p for r in REGISTRY for p in r.prefixes)})[A-Za-z0-9.]*\d[A-Za-z0-9.]*\b"
MENTION = rf"(?i)\b(?:{_alternation(n for r in REGISTRY for n in r.names)})\b"
#: Finds a name wherever MENTION does.
MENTION_TEST = rf"(?i)\b{factored(n.lower() for r in REGISTRY for n in r.names)}\b"
#: Finds an accession wherever ACCESSION does.
ACCESSION_TEST = rf"\b{factored(p for r in REGISTRY for p in r.prefixes)}[A-Za-z0-9.]*\d[A-Za-z0-9.]*\b"
DOI_START = r"(?i)^10\.\d{4,9}/"
CANONICALS = tuple(dict.fromkeys(r.canonical for r in REGISTRY))


def first_prefix() -> str:
    """A pattern that takes the prefix of the first entry that has one of a text's beginning; "" stays for none."""
    return "(?i)^(" + "|".join(re.escape(p) for r in REGISTRY for p in r.prefixes) + ")"


def literal_map(pairs) -> Column:
    """A foldable map from an iterable of string pairs; the first of equal keys holds."""
    known: dict[str, str] = {}
    for key, value in pairs:
        known.setdefault(key, value)
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])


def look_up(pairs, key: Column) -> Column:
    """The value of the first pair with that key, or null.

    A map is searched from its beginning, so there is one for each length of
    keys, in an array.
    """
    known: dict[int, list[tuple[str, str]]] = {}
    for name, value in pairs:
        known.setdefault(len(name.encode()), []).append((name, value))
    none = F.lit(None).cast("map<string,string>")
    maps = F.array(*[literal_map(known[n]) if n in known else none for n in range(max(known, default=0) + 1)])
    return F.try_element_at(F.try_element_at(maps, F.octet_length(key) + 1), key)


def exact_name(low: Column) -> Column:
    """The canonical name of a lower-cased name, or null."""
    return look_up(((n.lower(), r.canonical) for r in REGISTRY for n in r.names), low)


def known_group(low: Column) -> Column:
    """The synonym group of a lower-cased name, or null."""
    return look_up(((n.lower(), r.group) for r in REGISTRY for n in r.names), low)


def registry_frame(spark: SparkSession) -> DataFrame:
    """The registry as a table (pos, canonical, aliases, prefixes, shape, group, url)."""
    rows = [(i, r.canonical, list(r.aliases), list(r.prefixes), r.shape, r.group, r.url) for i, r in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "pos int, canonical string, aliases array<string>, prefixes array<string>, identifier_pattern string, synonym_group string, url_template string")


def prompt_block(indent: str = "") -> str:
    """The bullet list of repositories that goes into an extraction prompt."""
    prefixes: dict[str, list[str]] = {}
    for r in REGISTRY:
        prefixes.setdefault(r.canonical, []).extend(p for p in r.prefixes if not p.startswith("10."))
    lines = [f"  - {name}: " + (", ".join(f"{p}####" for p in dict.fromkeys(own)) if own else "DOI or repository-specific identifier") for name, own in prefixes.items()]
    return ("\n" + indent).join(lines)


def prompt_block_frame(spark: SparkSession) -> DataFrame:
    """(pos, canonical, bullet): the same bullets as rows, by aggregation."""
    r = registry_frame(spark)
    shown = F.filter("prefixes", lambda p: ~p.startswith("10."))
    grouped = r.groupBy("canonical").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", shown.alias("p")))).alias("all"))
    flat = F.transform(F.array_distinct(F.flatten(F.transform("all", lambda s: s["p"]))), lambda p: F.concat(p, F.lit("####")))
    text = F.when(F.size(flat) > 0, F.array_join(flat, ", ")).otherwise("DOI or repository-specific identifier")
    return grouped.select("pos", "canonical", F.concat(F.lit("  - "), "canonical", F.lit(": "), text).alias("bullet"))
