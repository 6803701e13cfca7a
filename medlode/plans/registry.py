"""Search parameters: which code of which type reads which path in which way.

A registry is a parameter of searches. The one here has the parameters of the projected types; those of all
types come from the published definitions, by `load` from a file of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

KINDS = ("string", "token", "reference", "date", "uri", "number", "quantity", "special")


# The type names of the public specification, in its order.
TYPES = """
Account ActivityDefinition ActorDefinition AdministrableProductDefinition AdverseEvent AllergyIntolerance
Appointment AppointmentResponse ArtifactAssessment AuditEvent Basic Binary BiologicallyDerivedProduct
BodyStructure Bundle CapabilityStatement CarePlan CareTeam Claim ClaimResponse ClinicalUseDefinition
CodeSystem Communication CommunicationRequest CompartmentDefinition Composition ConceptMap Condition
Consent Contract Coverage CoverageEligibilityRequest CoverageEligibilityResponse DetectedIssue Device
DeviceAlert DeviceAssociation DeviceDefinition DeviceMetric DeviceRequest DiagnosticReport
DocumentReference Encounter Endpoint EnrollmentRequest EnrollmentResponse EpisodeOfCare EventDefinition
Evidence EvidenceVariable ExampleScenario ExplanationOfBenefit FamilyMemberHistory Flag Goal Group
GuidanceResponse HealthcareService ImagingSelection ImagingStudy Immunization ImplementationGuide
Ingredient InsurancePlan InsuranceProduct Invoice Library List Location ManufacturedItemDefinition Measure
MeasureReport Medication MedicationAdministration MedicationDispense MedicationRequest MedicationStatement
MedicinalProductDefinition MessageDefinition MessageHeader NamingSystem NutritionIntake NutritionOrder
NutritionProduct Observation ObservationDefinition OperationDefinition OperationOutcome Organization
OrganizationAffiliation PackagedProductDefinition Parameters Patient PaymentNotice PaymentReconciliation
Person PlanDefinition Practitioner PractitionerRole Procedure Provenance Questionnaire
QuestionnaireResponse RegulatedAuthorization RelatedPerson RequestOrchestration Requirements ResearchStudy
ResearchSubject RiskAssessment Schedule SearchParameter ServiceRequest Slot Specimen SpecimenDefinition
StructureDefinition StructureMap Subscription SubscriptionStatus SubscriptionTopic Substance
SubstanceDefinition Task TerminologyCapabilities ValueSet VisionPrescription
""".split()


@dataclass(frozen=True)
class Path:
    """shape: field, where, alternatives, exists or position."""

    shape: str
    segments: tuple[str, ...] = ()
    field: str = ""
    value: str = ""
    suffix: tuple[str, ...] = ()
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Param:
    code: str
    kind: str
    path: Path


def parse_path(text: str) -> Path:
    if m := re.fullmatch(r"where:([\w.]+)\[(\w+)=([\w-]+)\](?:\.([\w.]+))?", text):
        return Path("where", tuple(m[1].split(".")), m[2], m[3], tuple(m[4].split(".")) if m[4] else ())
    if text.startswith("exists:"):
        return Path("exists", tuple(text[7:].split(".")))
    if text.startswith("position:"):
        return Path("position", tuple(text[9:].split(".")))
    if "|" in text:
        return Path("alternatives", options=tuple(text.split("|")))
    return Path("field", tuple(text.split(".")))


# Parameters of the projected types, as the public specification of resources names them.
_TEXT = """
Patient: active token active; address string address; address-city string address.city; address-country string address.country; birthdate date birthDate; death-date date deceasedDateTime; deceased token exists:deceased; email token where:telecom[system=email]; family string name.family; gender token gender; given string name.given; identifier token identifier; link reference link.other; name string name; organization reference managingOrganization; phone token where:telecom[system=phone]; telecom token telecom
Observation: code token code; category token category; component-code token component.code; component-value-quantity quantity component.valueQuantity; date date effectiveDateTime|effectivePeriod|effectiveTiming|effectiveInstant; derived-from reference derivedFrom; encounter reference encounter; identifier token identifier; patient reference subject.reference; performer reference performer; status token status; subject reference subject; value-quantity quantity valueQuantity; value-string string valueString; value-date date valueDateTime|valuePeriod
Encounter: class token class; date date actualPeriod; date-start date actualPeriod.start; end-date date actualPeriod.end; identifier token identifier; length quantity length; location-period date location.period; participant reference participant.actor; patient reference subject.reference; status token status; subject reference subject; type token type
Condition: clinical-status token clinicalStatus; code token code; onset-date date onsetDateTime|onsetPeriod; abatement-date date abatementDateTime|abatementPeriod; recorded-date date recordedDate; subject reference subject
Location: name string name; near special position:position; status token status; type token type
Organization: active token active; address-city string contact.address.city; identifier token identifier; name string name; partof reference partOf
Device: identifier token identifier; manufacturer string manufacturer; status token status; type token type
ResearchStudy: name string name; recruitment-actual number recruitment.actualNumber; recruitment-target number recruitment.targetNumber; status token status
DocumentReference: date date date; description string description; language token content.attachment.language; location uri content.attachment.url; status token status
Appointment: has-recurrence-template token exists:recurrenceTemplate; patient reference participant.actor.reference; slot reference slot; status token status
Library: composed-of reference where:relatedArtifact[type=composed-of].resource; depends-on reference where:relatedArtifact[type=depends-on].resource; name string name; status token status; url uri url
"""


@cache
def builtin() -> dict[str, dict[str, Param]]:
    out: dict[str, dict[str, Param]] = {}
    for line in _TEXT.strip().splitlines():
        kind, rest = line.split(": ", 1)
        out[kind] = {(p := x.split(" "))[0]: Param(p[0], p[1], parse_path(p[2])) for x in rest.split("; ")}
    return out


def load(spark, path: str) -> dict[str, dict[str, Param]]:
    """A registry from a file of published definitions: a JSON bundle of them, or one a line."""
    entry = "code string, type string, base array<string>, expression string"
    rows = spark.read.schema(f"{entry}, entry array<struct<resource: struct<{', '.join(x.replace(' ', ': ', 1) for x in entry.split(', '))}>>>").json(path, multiLine=True)
    rows = rows.selectExpr("inline(concat(coalesce(transform(entry, e -> e.resource), array()), array(struct(code, type, base, expression))))")
    return from_definitions([r.asDict() for r in rows.where("code is not null and base is not null").collect()])


def from_definitions(definitions: list[dict]) -> dict[str, dict[str, Param]]:
    """A registry from standard definitions; expressions beyond the path shapes, and composites, are left out."""
    out: dict[str, dict[str, Param]] = {}
    for d in definitions:
        if d.get("type") not in KINDS or not d.get("expression"):
            continue
        for base in d.get("base", []):
            own = [e.strip() for e in d["expression"].split("|") if e.strip().startswith(f"{base}.")]
            own = [re.sub(r"\.(?:ofType|as)\((\w)(\w*)\)", lambda m: m[1].upper() + m[2], e.removeprefix(f"{base}.")) for e in own]
            own = [re.sub(r"\.where\((\w+)='([\w-]+)'\)", r"[\1=\2]", e) for e in own]
            if not own or any(re.search(r"[^\w.\[\]=-]", e) for e in own):
                continue
            text = "|".join(own) if d["type"] == "date" and len(own) > 1 else own[0]
            if d["type"] == "special":
                text = f"position:{text}"
            elif text.endswith(".exists"):
                text = f"exists:{text.removesuffix('.exists')}"
            elif "[" in text:
                text = f"where:{text}"
            out.setdefault(base, {})[d["code"]] = Param(d["code"], d["type"], parse_path(text))
    return out
