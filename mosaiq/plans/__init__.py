"""mosaiq.plans"""
