"""Jobs composed from the operators: derived tables and site audits."""
