"""State over time: sessions, consent, incremental preparation."""
