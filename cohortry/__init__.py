"""Cohort analytics on PySpark: adherence, donor features, bias audits, model quality."""
