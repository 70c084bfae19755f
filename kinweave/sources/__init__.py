"""Readers, writers and the table bindings of the network."""
