"""Prompt templates: a small table, its lookup, and a log of their use (X-53, F-44, E-06, Z-12, Z-13; A-17 is ``sessions.template_usage``)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "pos int, name string, title string, task string, jurisdiction string, document_type string, system string, body string, variables array<string>"
LOG = "template string, at timestamp, variables array<string>, success boolean, error string"


@dataclass
class Template:
    """A prompt with named variables; it fits any jurisdiction or kind of document where none is given."""

    title: str
    task: str
    system: str
    variables: list[str]
    jurisdiction: str | None = None
    document_type: str | None = None
    lead: str = ""

    @property
    def body(self) -> str:
        return self.lead + "".join(f"\n{v.replace('_', ' ').capitalize()}: {{{v}}}" for v in self.variables)

    def render(self, **values) -> dict[str, str]:
        """X-53: system and user text; missing variables are an error that names them (U-05)."""
        missing = [v for v in self.variables if v not in values]
        if missing:
            raise ValueError(f"missing: {', '.join(missing)}")
        return {"system": self.system, "user": self.body.format(**values)}


def _built_in() -> dict[str, Template]:
    vn = "vietnam"
    return {
        "document_analysis": Template("Legal Document Analysis", "document_analysis", "You analyse legal documents and cite the passages you rely on.", ["document_type", "document_title", "jurisdiction", "document_content", "analysis_requirements"], vn, lead="Analyse this document."),
        "legal_research": Template("Legal Research Assistant", "legal_research", "You research law and name every source.", ["research_question", "legal_area", "jurisdiction", "specific_focus", "additional_context", "research_scope"], vn, lead="Research this question."),
        "contract_review": Template("Contract Review and Analysis", "contract_review", "You review contracts for gaps, risks and unfair terms.", ["contract_type", "parties", "jurisdiction", "review_purpose", "contract_content", "review_focus", "risk_tolerance"], None, "contract", lead="Review this contract."),
        "compliance_check": Template("Legal Compliance Assessment", "compliance_check", "You judge whether practices keep to the law.", ["organization", "industry", "jurisdiction", "compliance_area", "current_practices", "compliance_questions", "risk_tolerance"], vn, lead="Assess compliance."),
        "legal_qa": Template("Legal Question Answering", "legal_qa", "You answer questions of law plainly.", ["question", "legal_area", "jurisdiction", "context", "questioner_background", "urgency_level"], vn, lead="Answer this question."),
        "case_analysis": Template("Legal Case Analysis", "case_analysis", "You take court decisions apart.", ["case_name", "court", "date", "legal_area", "case_facts", "legal_issues", "court_decision", "analysis_focus"], None, "case_law", lead="Analyse this case."),
        "risk_assessment": Template("Legal Risk Assessment", "risk_assessment", "You weigh legal risks and rank them.", ["subject", "business_context", "jurisdiction", "time_horizon", "current_situation", "risk_areas", "risk_tolerance"], vn, lead="Assess these risks."),
    }


FOLLOW_UPS = {
    "document_analysis": ["Which clauses need a closer look?", "How could this document be improved?", "Is any rule of compliance touched?"],
    "legal_research": ["Which decisions bear on this?", "What has changed in the rules of late?", "How do other jurisdictions treat it?"],
    "compliance_check": ["What would a plan to comply contain?", "How should compliance be watched?", "Which risks does this situation carry?"],
    "": ["Which point needs more detail?", "What else is open on this subject?", "Which related documents should be read?"],
}


@dataclass
class Library:
    """Templates by name, and the log of their use as rows of ``LOG``."""

    templates: dict[str, Template] = field(default_factory=_built_in)
    log: list[tuple] = field(default_factory=list)

    def add(self, template: Template) -> str:
        """E-06: under its title in lower case with underscores."""
        name = template.title.lower().replace(" ", "_")
        self.templates[name] = template
        return name

    def prompt(self, name: str, now: dt.datetime | None = None, **values) -> dict[str, str]:
        """Z-12: a filled template; success and failure are logged alike."""
        error = None
        try:
            if name not in self.templates:
                raise ValueError(f"no template {name}")
            return self.templates[name].render(**values)
        except ValueError as e:
            error = str(e)
            raise
        finally:
            self.log.append((name, now or dt.datetime.now(), list(values), error is None, error))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, n, t.title, t.task, t.jurisdiction, t.document_type, t.system, t.body, t.variables) for i, (n, t) in enumerate(self.templates.items())]
        return spark.createDataFrame(rows, SCHEMA)

    def usage(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, LOG)


def lookup(templates: DataFrame, task: str | None = None, jurisdiction: str | None = None, document_type: str | None = None) -> DataFrame:
    """F-44: templates that have each given property, in order; one that isn't given is no filter."""
    for name, value in (("task", task), ("jurisdiction", jurisdiction), ("document_type", document_type)):
        if value is not None:
            templates = templates.where(F.col(name) == value)
    return templates.orderBy("pos")


def variables(question: str, task: str = "legal_qa", jurisdiction: str | None = None, urgency: str = "normal", document_type: str | None = None, mode: str = "detailed") -> dict[str, str]:
    """Z-13: values for a task's template from a bare question."""
    out = {"question": question, "legal_area": "General Legal", "jurisdiction": jurisdiction or "Vietnam", "context": "Legal consultation request", "questioner_background": "Legal consultation client", "urgency_level": urgency}
    if task == "document_analysis":
        out |= {"document_type": document_type or "Legal Document", "document_title": "Document for Analysis", "document_content": "[Document content will be provided]", "analysis_requirements": f"Provide {mode} analysis"}
    if task == "legal_research":
        out |= {"research_question": question, "specific_focus": "Comprehensive legal analysis", "additional_context": "Legal research request", "research_scope": "Current laws and regulations"}
    return out


def follow_ups(task: str) -> list[str]:
    """Z-13: three questions to go on with."""
    return FOLLOW_UPS.get(task, FOLLOW_UPS[""])[:3]
