"""Policy texts and canonical templates as small dimension tables (S3).

`read_reference_texts` loads them from a folder of files (id = file stem);
the built-in copies below are used when no folder is given.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (must equal the reference's shipped policy texts and templates;
# they are data: the policy text is attached to violations, the templates are
# what document paragraphs are compared with).
POLICIES = {
    "CONTRACT_001": (
        "POLICY: Contract Termination Clause\n\n"
        "All contracts must include a clear termination clause that specifies:\n"
        "- Conditions under which the contract may be terminated\n"
        "- Required notice period (minimum 30 days)\n"
        "- Process for termination\n"
        "- Consequences of termination\n\n"
        "Contracts without termination clauses are non-compliant and must be rejected or amended.\n\n"
    ),
    "HR_001": (
        "POLICY: HR Form Manager Approval\n\n"
        "All HR forms and employee requests must include:\n"
        "- Manager approval field\n"
        "- Manager signature line\n"
        "- Date of approval\n\n"
        "Forms missing manager approval are non-compliant and require review before processing.\n\n"
    ),
    "INVOICE_001": (
        "POLICY: Invoice Tax Identification\n\n"
        "All invoices must include:\n"
        "- Tax identification number (TIN, EIN, or VAT number)\n"
        "- Tax ID format must be clearly labeled\n"
        "- Tax ID must be valid and verifiable\n\n"
        "Invoices without tax identification are non-compliant and cannot be processed for payment.\n\n"
    ),
    "POLICY_001": (
        "POLICY: Policy Document Versioning\n\n"
        "All policy documents must include:\n"
        "- Version number (e.g., v1.0, v2.1)\n"
        "- Effective date\n"
        "- Review date (optional but recommended)\n\n"
        "Policy documents without version numbers cannot be tracked and must be updated.\n\n"
    ),
}

TEMPLATES = {
    "contract_template": (
        "CONTRACT AGREEMENT\n\n"
        "This Agreement is entered into on {date} between Party A and Party B.\n\n"
        "TERMINATION: This agreement may be terminated by either party with 30 days written notice.\n\n"
        "PAYMENT TERMS: Payment shall be made within 30 days of invoice receipt.\n\n"
        "SIGNED BY:\n"
        "Party A: ___________________\n"
        "Party B: ___________________\n"
    ),
    "hr_form_template": (
        "EMPLOYEE REQUEST FORM\n\n"
        "Employee Name: {name}\n"
        "Department: {department}\n"
        "Request Type: {request_type}\n\n"
        "MANAGER APPROVAL REQUIRED:\n"
        "Manager Signature: ___________________\n"
        "Date: {date}\n"
    ),
    "invoice_template": (
        "INVOICE\n\n"
        "Invoice Number: {invoice_number}\n"
        "Date: {date}\n"
        "Bill To: {company}\n\n"
        "Items:\n"
        "{items}\n\n"
        "Total Amount: ${amount}\n\n"
        "TAX ID: {tax_id}\n"
    ),
    "policy_template": (
        "COMPANY POLICY DOCUMENT\n\n"
        "Version: {version}\n"
        "Effective Date: {date}\n\n"
        "POLICY STATEMENT:\n"
        "{policy_text}\n\n"
        "This policy is subject to review and update.\n"
    ),
}

TEMPLATE_STORED_AT = datetime(2024, 1, 1)


def policies_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(POLICIES.items()), "policy_id string, content string")


def templates_table(spark: SparkSession) -> DataFrame:
    """templates(template_id, text, stored_at); embeddings are added by drift."""
    rows = [(k, v, TEMPLATE_STORED_AT) for k, v in sorted(TEMPLATES.items())]
    return spark.createDataFrame(rows, "template_id string, text string, stored_at timestamp")


def read_reference_texts(spark: SparkSession, folder: str, suffixes=(".txt", ".md"),
                         id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Every `*.txt`/`*.md` file of a folder as one row: (id = file stem, text)."""
    rows = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return reference_rows(rows, suffixes, id_col, text_col)


def reference_rows(files: DataFrame, suffixes=(".txt", ".md"), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(name, text) rows of files with one of the suffixes as (id, text)."""
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.col("name").endswith(s)
    return files.filter(ok).select(F.regexp_replace("name", r"\.[^.]*$", "").alias(id_col), F.col("text").alias(text_col))
