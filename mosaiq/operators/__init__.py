"""mosaiq.operators"""
