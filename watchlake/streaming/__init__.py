"""Keeping the tables up to date as files arrive."""
