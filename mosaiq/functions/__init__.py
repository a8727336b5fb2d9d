"""mosaiq.functions"""
