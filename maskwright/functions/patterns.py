"""Fixed values of the identifier detectors: labels, patterns and allowlists."""

from __future__ import annotations

# Patterns in detector order. Where a pattern has a group, the group is the identifier and ends the match.
_PHONE = r"(?:\+\d{1,3}[-.\s]?)?(?:\d{3}[-.]\d{3}[-.]\d{4}|\(\d{3}\)\s?\d{3}[-.]\d{4})"
_EXT = r"(?:x|ext\.?|extension)"
ADDRESS = r"\b\d{1,6}\s+(?:[A-Z][a-z]+\s+){1,4}(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Ct|Court)\b"
NAME = r"\bPatient\s+([A-Z][a-z]+\s+[A-Z][a-z]+)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
FAX = rf"(?i)\b(?:fax|facsimile)(?:\s+(?:number|no\.))?\s*:?\s*({_PHONE}(?!\s+{_EXT}\s*\d{{6,}}(?![A-Za-z0-9-]))(?:\s+{_EXT}\s*\d{{1,5}})?)(?![A-Za-z0-9-])"
PHONE_OVERLONG = rf"(?i)(?<![A-Za-z0-9-]){_PHONE}\s+{_EXT}\s*\d{{6,}}(?![A-Za-z0-9-])"
PHONE_EXTENSION = rf"(?i)(?<![A-Za-z0-9-]){_PHONE}\s+{_EXT}\s*\d{{1,5}}(?![A-Za-z0-9-])"
PHONE = rf"(?<![A-Za-z0-9-]){_PHONE}(?![A-Za-z0-9-])"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})(?!\d)"
SSN = r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])"
_NOT_AFTER_ID = r"(?<!(?i:MRN|ID)[- ])"
PASSPORT = rf"{_NOT_AFTER_ID}(?<![A-Za-z0-9-])[A-Z]\d{{8}}(?![A-Za-z0-9-])"
PASSPORT_NUMERIC = r"(?i)\b(?:passport(?:\s+(?:number|no\.?))?)\s+(\d{9})(?![A-Za-z0-9-])"
INSURANCE_ID = r"(?i)\b(?:insurance(?:\s+(?:id|number|policy))?|member(?:\s+(?:id|number))?|policy(?:\s+(?:id|number))?)\s+(?:ID\s+)?([A-Z]{2,4}-?\d{6,10}|[A-Z]{3}\d{6,10})(?![A-Za-z0-9-])"
DEA_NUMBER = r"\b(?:DEA|DEA\s+(?:number|no\.?|registration(?:\s+number)?))\s+([A-Z]{2}\d{7})(?![A-Za-z0-9-])"
AGE = r"(?i)\b(?:age|aged|patient\s+age)\s+(\d{1,3})\b"
FACILITY = r"\b(?:facility|hospital|clinic|site|location)\s+([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){0,5}\s+(?:Hospital|Clinic|Medical\s+Center|Health\s+Center|Facility))\b"
NPI = r"(?i)\bNPI\s*(?:number|no\.)?\s*(\d{10})(?!\d)"
LICENSE_PLATE = r"(?i)\b(?:license\s+plate|plate(?:\s+(?:number|no\.))?)\s+([A-Z0-9]{2,4}-[A-Z0-9]{2,4})(?![A-Za-z0-9-])"
VIN = r"(?i)\b(?:VIN|vehicle(?:\s+(?:id|identification(?:\s+number)?|VIN))?)\s+([A-HJ-NPR-Z0-9]{17})(?![A-Za-z0-9-])"
DRIVER_LICENSE = r"(?i)\b(?:(?:driver(?:'s|s)?[-\s]+license)|DL(?:\s+(?:no\.?|number))?)(?:\s*(?:#|:)\s*|\s+)([A-Z]\d{7,8}|[A-Z]{1,2}-?\d{6,8})(?![A-Za-z0-9-])"
IP_ADDRESS = r"(?<![A-Za-z0-9.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![A-Za-z0-9.])"
URL = r"(?<![A-Za-z0-9_])https?://(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,8}(?=$|[/?#]|[^A-Za-z0-9_.-])(?:[/?#][A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*[A-Za-z0-9/#=%])?(?![A-Za-z0-9_])"
ZIP = rf"{_NOT_AFTER_ID}(?!{ADDRESS})(?<![A-Za-z0-9-])\d{{5}}(?:-\d{{4}})?(?![A-Za-z0-9-])"
MRN = r"(?i)\bMRN[- ]?(?:\d+|[A-Z]\d{8})\b"
ID = r"(?i)\bID[- ]?(?:\d+|[A-Z]\d{8})\b"

#: Labels that a report may carry.
LABELS = [
    "NAME",
    "MRN",
    "EMAIL",
    "PHONE",
    "FAX",
    "ID",
    "DATE",
    "ADDRESS",
    "SSN",
    "PASSPORT",
    "ZIP",
    "INSURANCE_ID",
    "DEA_NUMBER",
    "AGE",
    "FACILITY",
    "NPI",
    "LICENSE_PLATE",
    "VIN",
    "DRIVER_LICENSE",
    "IP_ADDRESS",
    "URL",
]
#: Labels of the evidence report, of the bridge and of the published summary.
EVIDENCE_LABELS = ["EMAIL", "MRN", "NAME", "PHONE"]
