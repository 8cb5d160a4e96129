"""Readers, the stored tables' semantics, the demo generator and exports."""
