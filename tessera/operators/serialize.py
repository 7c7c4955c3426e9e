"""Records as text for the index, and the metadata kept beside a vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import first_present, prefix, present, split_list

# The labels of the two language tracks.
LABELS_EN = {"skills": "SKILLS", "summary": "SUMMARY", "experience": "EXPERIENCE", "education": "EDUCATION", "description": "JOB DESCRIPTION"}
LABELS_UR = {"skills": "مہارتیں", "summary": "خلاصہ", "experience": "تجربہ", "education": "تعلیم", "description": "تفصیل ملازمت"}
UNKNOWN_UR = "نامعلوم"


def block(label: str, value: Column) -> Column:
    """A labelled block, or null (which concat_ws skips) if the value is missing."""
    return F.when(present(value).isNotNull(), F.concat(F.lit(f"\n{label}:\n"), value))


def candidate(name: Column, category: Column, location: Column, skills: Column, summary: Column, experience: Column, education: Column) -> Column:
    head = F.concat(F.lit("Name: "), first_present(name, default="Unknown"), F.lit(" | Category: "), first_present(category, default="Not specified"), F.lit(" | Location: "), first_present(location, default="Not specified"))
    parts = {"skills": skills, "summary": summary, "experience": prefix(experience, 2000), "education": education}
    return F.concat_ws("\n", head, *(block(LABELS_EN[k], v) for k, v in parts.items()))


def candidate_urdu(name: Column, category_urdu: Column, category: Column, skills_urdu: Column, skills: Column, summary: Column, experience: Column, education: Column) -> Column:
    head = F.concat(F.lit("نام: "), first_present(name, default=UNKNOWN_UR), F.lit(" | زمرہ: "), first_present(category_urdu, category))
    parts = {"skills": first_present(skills_urdu, skills), "summary": summary, "experience": prefix(experience, 2000), "education": education}
    return F.concat_ws("\n", head, *(block(LABELS_UR[k], v) for k, v in parts.items()))


def job(title: Column, other_title: Column, description: Column, other_description: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Job Title: "), first_present(title, other_title, default="Unknown")), block(LABELS_EN["description"], prefix(first_present(description, other_description), 3000)))


def job_urdu(title: Column, other_title: Column, description: Column, other_description: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("عنوان ملازمت: "), first_present(title, other_title, default=UNKNOWN_UR)), block(LABELS_UR["description"], prefix(first_present(description, other_description), 3000)))


def skills_urdu(c: Column) -> Column:
    """Pieces at the Arabic comma, or at the plain one only if that gives none."""
    arabic = split_list(c, "،")
    return F.when(F.size(arabic) > 0, arabic).otherwise(split_list(c))


def candidate_metadata(ident: Column, name: Column, category: Column, location: Column, skills: Column, education: Column, text: Column, urdu: bool = False) -> Column:
    listed = skills_urdu(first_present(skills)) if urdu else split_list(first_present(skills))
    return F.struct(F.lit("candidate").alias("type"), ident.alias("resume_id"), first_present(name).alias("name"), first_present(category).alias("category"), first_present(location).alias("location"), F.slice(listed, 1, 20).alias("skills"), prefix(first_present(education), 500).alias("education"), prefix(text, 4000).alias("text"))


def job_metadata(ident: Column, title: Column, text: Column) -> Column:
    return F.struct(F.lit("job").alias("type"), ident.alias("job_id"), first_present(title).alias("job_title"), prefix(text, 4000).alias("text"))
