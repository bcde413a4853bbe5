"""Readers and writers of subtitle and transcript formats."""
