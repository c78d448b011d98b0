"""Query operators over the job and directory tables."""
