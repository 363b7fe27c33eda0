"""Posthorn: inbound-mail intelligence and corpus preparation, expressed as Spark plans."""
