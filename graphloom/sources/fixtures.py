"""A small security graph with known results, as tables, rules, shapes and labelled questions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import TYPE, ClassSpec, edges_to_triples, literal_graph, tables_to_triples, union_graphs
from ..operators.rules import RuleSpec
from ..operators.shapes import Constraint

# Entities, edges, names and limits that the known results depend on.
TABLES = {
    "threat_actors": (
        "actor_id string, actor_name string, actor_type string, primary_motivation string",
        [
            ("TA001", "APT-29", "State-Sponsored", "Credential Theft"),
            ("TA002", "Shadow Spider", "Cybercrime", "Ransomware"),
            ("TA003", "Crimson Fox", "Cybercrime", "Financial Theft"),
            ("TA004", "Silent Raven", "Espionage", "Data Exfiltration"),
            ("TA005", "Dark Hydra", "Cybercrime", "Credential Theft"),
        ],
    ),
    "malware": (
        "malware_id string, malware_name string, malware_type string",
        [
            ("MAL001", "SolarDrop", "Backdoor"),
            ("MAL002", "BlackCrypt", "Ransomware"),
            ("MAL003", "CredentialFox", "Credential Stealer"),
            ("MAL004", "SilentLoader", "Loader"),
            ("MAL005", "HydraBot", "Botnet"),
        ],
    ),
    "vulnerabilities": (
        "cve_id string, severity string, cvss_score double, vulnerability_type string",
        [
            ("CVE-2026-1001", "Critical", 9.8, "Remote Code Execution"),
            ("CVE-2026-1002", "High", 8.1, "Privilege Escalation"),
            ("CVE-2026-1003", "Critical", 9.5, "Authentication Bypass"),
            ("CVE-2026-1004", "Medium", 6.5, "Information Disclosure"),
            ("CVE-2026-1005", "High", 8.8, "Remote Code Execution"),
        ],
    ),
    "campaigns": (
        "campaign_id string, campaign_name string, attack_vector string",
        [
            ("CAM001", "Operation Nightfall", "Phishing"),
            ("CAM002", "Operation Black Ice", "Ransomware"),
            ("CAM003", "Operation Silent Web", "Credential Theft"),
            ("CAM004", "Operation Red Cloud", "Espionage"),
        ],
    ),
    "organizations": (
        "organization_id string, organization_name string, industry string",
        [
            ("ORG001", "FinBank Ltd", "Banking"),
            ("ORG002", "HealthSecure", "Healthcare"),
            ("ORG003", "CloudRetail", "Retail"),
            ("ORG004", "TechNova", "Technology"),
            ("ORG005", "PaySphere", "FinTech"),
        ],
    ),
    "domains": (
        "domain_id string, domain_name string",
        [
            ("DOM001", "secure-update-example.com"),
            ("DOM002", "cloud-login-example.net"),
            ("DOM003", "payment-check-example.org"),
            ("DOM004", "mail-auth-example.net"),
            ("DOM005", "software-update-example.org"),
        ],
    ),
    "ip_addresses": (
        "ip_id string, ip_address string",
        [("IP001", "192.0.2.10"), ("IP002", "192.0.2.20"), ("IP003", "198.51.100.30"), ("IP004", "198.51.100.40"), ("IP005", "203.0.113.50")],
    ),
    "relationships": (
        "source_id string, relationship string, target_id string",
        [
            ("TA001", "USES_MALWARE", "MAL001"),
            ("TA002", "USES_MALWARE", "MAL002"),
            ("TA003", "USES_MALWARE", "MAL003"),
            ("TA004", "USES_MALWARE", "MAL004"),
            ("TA005", "USES_MALWARE", "MAL005"),
            ("MAL001", "EXPLOITS", "CVE-2026-1001"),
            ("MAL002", "EXPLOITS", "CVE-2026-1002"),
            ("MAL003", "EXPLOITS", "CVE-2026-1003"),
            ("MAL004", "EXPLOITS", "CVE-2026-1004"),
            ("MAL005", "EXPLOITS", "CVE-2026-1005"),
            ("TA001", "ATTRIBUTED_TO_CAMPAIGN", "CAM001"),
            ("TA002", "ATTRIBUTED_TO_CAMPAIGN", "CAM002"),
            ("TA003", "ATTRIBUTED_TO_CAMPAIGN", "CAM003"),
            ("TA004", "ATTRIBUTED_TO_CAMPAIGN", "CAM004"),
            ("CAM001", "TARGETS", "ORG001"),
            ("CAM001", "TARGETS", "ORG005"),
            ("CAM002", "TARGETS", "ORG002"),
            ("CAM003", "TARGETS", "ORG003"),
            ("CAM004", "TARGETS", "ORG004"),
            ("MAL001", "COMMUNICATES_WITH", "DOM001"),
            ("MAL002", "COMMUNICATES_WITH", "DOM002"),
            ("MAL003", "COMMUNICATES_WITH", "DOM003"),
            ("MAL004", "COMMUNICATES_WITH", "DOM004"),
            ("MAL005", "COMMUNICATES_WITH", "DOM005"),
            ("DOM001", "RESOLVES_TO", "IP001"),
            ("DOM002", "RESOLVES_TO", "IP002"),
            ("DOM003", "RESOLVES_TO", "IP003"),
            ("DOM004", "RESOLVES_TO", "IP004"),
            ("DOM005", "RESOLVES_TO", "IP005"),
        ],
    ),
    "incoming": (
        "incoming_id string, incoming_name string, entity_type string",
        [
            ("INC001", "APT29", "ThreatActor"),
            ("INC002", "APT 29", "ThreatActor"),
            ("INC003", "Shadow-Spider", "ThreatActor"),
            ("INC004", "CrimsonFox", "ThreatActor"),
            ("INC005", "Blue Falcon", "ThreatActor"),
            ("INC006", "Solar Drop", "Malware"),
            ("INC007", "black-crypt", "Malware"),
            ("INC008", "Credential Fox", "Malware"),
            ("INC009", "Silent Loader", "Malware"),
            ("INC010", "NightCrawler", "Malware"),
        ],
    ),
    "reviews": (
        "incoming_name string, reviewer_decision string, canonical_id string, canonical_name string",
        [
            ("APT29", "REUSE", "TA001", "APT-29"),
            ("APT 29", "REUSE", "TA001", "APT-29"),
            ("Shadow-Spider", "REUSE", "TA002", "Shadow Spider"),
            ("CrimsonFox", "REUSE", "TA003", "Crimson Fox"),
            ("Blue Falcon", "NEW_ENTITY", None, None),
            ("Solar Drop", "REUSE", "MAL001", "SolarDrop"),
            ("black-crypt", "REUSE", "MAL002", "BlackCrypt"),
            ("Credential Fox", "REUSE", "MAL003", "CredentialFox"),
            ("Silent Loader", "REUSE", "MAL004", "SilentLoader"),
            ("NightCrawler", "NEW_ENTITY", None, None),
        ],
    ),
    "labelled_questions": (
        "question_id int, question string, expected_entity_id string, expected_facts array<string>",
        [
            (1, "What malware and vulnerability are associated with APT29?", "TA001", ["SolarDrop", "CVE-2026-1001"]),
            (2, "What infrastructure is connected to APT-29?", "TA001", ["secure-update-example.com", "192.0.2.10"]),
            (3, "Which campaign is associated with APT29?", "TA001", ["Operation Nightfall"]),
            (4, "What organization is targeted by Operation Black Ice?", "CAM002", ["ORG002"]),
            (5, "What vulnerability is connected to SolarDrop?", "MAL001", ["CVE-2026-1001"]),
            (6, "What IP address is connected to SolarDrop?", "MAL001", ["192.0.2.10"]),
            (7, "Which threat actor uses BlackCrypt?", "MAL002", ["Shadow Spider"]),
            (8, "What campaign is associated with Crimson Fox?", "TA003", ["Operation Silent Web"]),
            (9, "What infrastructure is connected to HydraBot?", "MAL005", ["software-update-example.org", "203.0.113.50"]),
            (10, "What campaign is associated with Silent Raven?", "TA004", ["Operation Red Cloud"]),
        ],
    ),
}
CLASSES = {
    "threat_actors": ClassSpec("ThreatActor", "actor_id", {"actor_id": "actorId", "actor_name": "actorName", "actor_type": "actorType", "primary_motivation": "primaryMotivation"}),
    "malware": ClassSpec("Malware", "malware_id", {"malware_id": "malwareId", "malware_name": "malwareName", "malware_type": "malwareType"}),
    "vulnerabilities": ClassSpec("Vulnerability", "cve_id", {"cve_id": "cveId", "severity": "severity", "cvss_score": "cvssScore", "vulnerability_type": "vulnerabilityType"}),
    "campaigns": ClassSpec("Campaign", "campaign_id", {"campaign_id": "campaignId", "campaign_name": "campaignName", "attack_vector": "attackVector"}),
    "organizations": ClassSpec("Organization", "organization_id", {"organization_id": "organizationId", "organization_name": "organizationName", "industry": "industry"}),
    "domains": ClassSpec("Domain", "domain_id", {"domain_id": "domainId", "domain_name": "domainName"}),
    "ip_addresses": ClassSpec("IPAddress", "ip_id", {"ip_id": "ipId", "ip_address": "ipAddress"}),
}
PREDICATES = {"USES_MALWARE": "usesMalware", "EXPLOITS": "exploits", "ATTRIBUTED_TO_CAMPAIGN": "attributedToCampaign", "TARGETS": "targets", "COMMUNICATES_WITH": "communicatesWith", "RESOLVES_TO": "resolvesTo"}
#: Object properties: domain and range.
ENDS = {"usesMalware": ("ThreatActor", "Malware"), "exploits": ("Malware", "Vulnerability"), "attributedToCampaign": ("ThreatActor", "Campaign"), "targets": ("Campaign", "Organization"), "communicatesWith": ("Malware", "Domain"), "resolvesTo": ("Domain", "IPAddress")}
PARENTS = {"ThreatActor": "CyberThreatEntity", "Malware": "CyberThreatEntity", "Vulnerability": "CyberThreatEntity", "Campaign": "CyberThreatEntity", "Organization": "CyberThreatEntity", "Infrastructure": "CyberThreatEntity", "Domain": "Infrastructure", "IPAddress": "Infrastructure"}
RULES = (
    RuleSpec("SEM001", "Actor uses malware", "High", "ThreatActor", "usesMalware"),
    RuleSpec("SEM002", "Malware is used by an actor", "Medium", "Malware", "usesMalware", "in"),
    RuleSpec("SEM003", "Malware exploits a vulnerability", "High", "Malware", "exploits"),
    RuleSpec("SEM004", "Vulnerability is exploited", "Medium", "Vulnerability", "exploits", "in"),
    RuleSpec("SEM005", "Campaign targets an organization", "High", "Campaign", "targets"),
    RuleSpec("SEM006", "Organization is targeted", "Low", "Organization", "targets", "in"),
    RuleSpec("SEM007", "Domain resolves to an address", "High", "Domain", "resolvesTo"),
    RuleSpec("SEM008", "Address is resolved to", "Low", "IPAddress", "resolvesTo", "in"),
)
#: Patterns, lengths, lists, bounds and classes of the properties; all others are required once, as text.
PATTERNS = {"actorId": "^TA[0-9]{3}$", "malwareId": "^MAL[0-9]{3}$", "cveId": "^CVE-[0-9]{4}-[0-9]{4,}$", "campaignId": "^CAM[0-9]{3}$", "organizationId": "^ORG[0-9]{3}$", "domainId": "^DOM[0-9]{3}$", "ipId": "^IP[0-9]{3}$"}
NAMES_OF_TWO = ("actorName", "malwareName")
SEVERITIES = ("Low", "Medium", "High", "Critical")
SCORE_BOUNDS = (0.0, 10.0)
REQUIRED_EDGES = ("usesMalware", "exploits", "communicatesWith", "targets", "resolvesTo")
FAULTS = [
    ("CVE_INVALID_001", TYPE, "Vulnerability", "iri", None),
    ("CVE_INVALID_001", "cveId", "CVE-2026-9999", "literal", "xsd:string"),
    ("CVE_INVALID_001", "severity", "Critical", "literal", "xsd:string"),
    ("CVE_INVALID_001", "cvssScore", "15.5", "literal", "xsd:decimal"),
    ("CVE_INVALID_001", "vulnerabilityType", "Remote Code Execution", "literal", "xsd:string"),
    ("CVE_INVALID_002", TYPE, "Vulnerability", "iri", None),
    ("CVE_INVALID_002", "cveId", "CVE-2026-9998", "literal", "xsd:string"),
    ("CVE_INVALID_002", "severity", "Extreme", "literal", "xsd:string"),
    ("CVE_INVALID_002", "cvssScore", "9.5", "literal", "xsd:decimal"),
    ("CVE_INVALID_002", "vulnerabilityType", "Authentication Bypass", "literal", "xsd:string"),
    ("TA999", TYPE, "ThreatActor", "iri", None),
    ("TA999", "actorId", "TA999", "literal", "xsd:string"),
    ("TA999", "actorName", "Unknown Phantom", "literal", "xsd:string"),
    ("TA999", "actorType", "Unknown", "literal", "xsd:string"),
    ("TA999", "primaryMotivation", "Unknown", "literal", "xsd:string"),
]


def fixture(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


#: What each class and edge is, in a sentence.
COMMENTS = {
    "CyberThreatEntity": "Anything that takes part in an attack or its defence.",
    "Infrastructure": "Hosts and names that attacks run over.",
    "ThreatActor": "A group or person behind attacks.",
    "Malware": "A program made to do harm.",
    "Vulnerability": "A flaw that a program can be attacked through.",
    "Campaign": "Attacks that belong together.",
    "Organization": "A company or body that may be attacked.",
    "Domain": "A host name seen in an attack.",
    "IPAddress": "A network address seen in an attack.",
    "usesMalware": "From an actor to its programs.",
    "exploits": "From a program to the flaws it needs.",
    "attributedToCampaign": "From an actor to the attacks ascribed to it.",
    "targets": "From attacks to whom they are aimed at.",
    "communicatesWith": "From a program to the host names it calls.",
    "resolvesTo": "From a host name to its address.",
}


def words_of(name: str) -> str:
    """A label from a name: `attributedToCampaign` is "attributed to campaign", `IPAddress` is "IP address"."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)
    return " ".join(p if p.isupper() else p.lower() for p in parts)


def ontology(spark: SparkSession) -> DataFrame:
    """The ontology itself, its classes, subclass edges and properties, with kind, domain, range, label and comment: 152 triples."""

    def said(name: str, label: str, predicate: str = "rdfs:label"):
        return (name, predicate, label, "literal", "xsd:string")

    rows = [("SecurityOntology", TYPE, "owl:Ontology", "iri", None), said("SecurityOntology", "security ontology"), said("SecurityOntology", "Actors, programs, flaws and infrastructure of attacks.", "rdfs:comment")]
    rows += [(c, TYPE, "owl:Class", "iri", None) for c in {*PARENTS, *PARENTS.values()}]
    rows += [(c, "rdfs:subClassOf", p, "iri", None) for c, p in PARENTS.items()]
    for spec in CLASSES.values():
        for prop in spec.properties.values():
            rows += [(prop, TYPE, "owl:DatatypeProperty", "iri", None), (prop, "rdfs:domain", spec.name, "iri", None), (prop, "rdfs:range", "xsd:decimal" if prop == "cvssScore" else "xsd:string", "iri", None), said(prop, words_of(prop))]
    for prop, (domain, range_) in ENDS.items():
        rows += [(prop, TYPE, "owl:ObjectProperty", "iri", None), (prop, "rdfs:domain", domain, "iri", None), (prop, "rdfs:range", range_, "iri", None)]
    rows += [row for name, comment in COMMENTS.items() for row in (said(name, words_of(name)), said(name, comment, "rdfs:comment"))]
    return literal_graph(spark, sorted(rows), "ontology")


def security_graph(spark: SparkSession, faulty: bool = False) -> DataFrame:
    """Ontology and instances; with the planted faults if `faulty`."""
    parts = [ontology(spark)] + [tables_to_triples(fixture(spark, t), spec) for t, spec in CLASSES.items()] + [edges_to_triples(fixture(spark, "relationships"), PREDICATES)]
    return union_graphs(*parts, *([literal_graph(spark, FAULTS, "faults")] if faulty else []))


def shape_constraints() -> list[Constraint]:
    """The constraints of all classes, from the fixed values above."""
    out = []
    for spec in CLASSES.values():
        shape = spec.name + "Shape"
        for prop in spec.properties.values():
            say = f"{spec.name} needs exactly one valid {prop}."
            add = lambda component, parameter: out.append(Constraint(shape, spec.name, prop, component, parameter, say))  # noqa: B023, E731
            add("minCount", 1)
            add("maxCount", 1)
            add("datatype", "xsd:decimal" if prop == "cvssScore" else "xsd:string")
            if prop in PATTERNS:
                add("pattern", PATTERNS[prop])
            if prop in NAMES_OF_TWO:
                add("minLength", 2)
            if prop == "severity":
                add("in", SEVERITIES)
            if prop == "cvssScore":
                add("minInclusive", SCORE_BOUNDS[0])
                add("maxInclusive", SCORE_BOUNDS[1])
        for edge in REQUIRED_EDGES:
            if ENDS[edge][0] == spec.name:
                say = f"{spec.name} needs {edge} to at least one {ENDS[edge][1]}."
                out += [Constraint(shape, spec.name, edge, "minCount", 1, say), Constraint(shape, spec.name, edge, "class", ENDS[edge][1], say)]
    return out
