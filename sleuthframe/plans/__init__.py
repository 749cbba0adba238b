"""sleuthframe.plans"""
