"""Readers and writers for the recording, marking and feature file formats."""
